"""SQL that states the library's queries anew, for DuckDB over the same tables.

Where a rule depends on what was taken before, a recursive query walks the lines of all recordings in step, with what
the rule remembers as a list. DuckDB's edit distance counts bytes, so other letters than ASCII's become single bytes first.
"""

from __future__ import annotations

WHITE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Letters of the test tables beyond ASCII, and as many characters that no text has.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
BYTES = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


def normalized(text: str) -> str:
    return f"""regexp_replace({text}, '[{WHITE}，。、,.…"'']', '', 'g')"""


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def plain(text: str) -> str:
    return f"translate({text}, '{LETTERS}', '{BYTES}')"


def units(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


LINES = """
lines AS (SELECT doc_id AS recording_id, i - 1 AS line_no, parts[i] AS text,
    53 * (i - 1) + (17 * (i - 1) * (i - 1) + 5 * doc_id) % 29 AS top
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS u(i))"""


def frames(text: str = "text") -> str:
    return LINES + f""",
sized AS (SELECT recording_id, greatest(1, CAST(ceil((max(top) - 390) / 131.0) AS BIGINT) + 1) AS n_frames FROM lines GROUP BY 1),
frames AS (SELECT recording_id, k AS frame_idx FROM sized, unnest(range(0, n_frames)) AS u(k)),
obs AS (SELECT l.recording_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(line_no AS INTEGER) AS line_no, {text} AS text, CAST(134 AS DOUBLE) AS x,
    CAST(160 + top - 131 * frame_idx AS DOUBLE) AS y, CAST(least(20 * length(text), 451) AS DOUBLE) AS w, CAST(28 AS DOUBLE) AS h
  FROM lines l JOIN frames f USING (recording_id) WHERE top - 131 * frame_idx >= 0 AND top - 131 * frame_idx < 420
  UNION ALL SELECT recording_id, CAST(frame_idx AS INTEGER), -1, 'Fixed header', 134, 100, 240, 28 FROM frames)"""


#: A recogniser's slip in the third character of some sightings.
MISREAD = "CASE WHEN (line_no + frame_idx) % 7 = 0 AND length(text) >= 12 THEN text[1:2] || '~' || text[4:] ELSE text END"


def clusters(name: str, source: str, keys: str) -> str:
    """``name(keys, members, votes, total, runner_up)``: the vote over ``source(keys, diff)``."""
    return f"""
{name}_cut AS (SELECT *, CASE WHEN diff - lag(diff) OVER (PARTITION BY {keys} ORDER BY diff) > 3 THEN 1 ELSE 0 END AS new FROM {source}),
{name}_chained AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY diff ROWS UNBOUNDED PRECEDING) AS cluster FROM {name}_cut),
{name}_grouped AS (SELECT {keys}, cluster, count(*) AS votes, min(diff) AS first, list(diff ORDER BY diff) AS members FROM {name}_chained GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT {keys}, members, votes, CAST(sum(votes) OVER (PARTITION BY {keys}) AS BIGINT) AS total, lead(votes) OVER w AS runner_up, row_number() OVER w AS rank
  FROM {name}_grouped WINDOW w AS (PARTITION BY {keys} ORDER BY votes DESC, first)) WHERE rank = 1)"""


def anchors(text: str = "text") -> str:
    return frames(text) + f""",
total AS (SELECT recording_id, count(*) AS frames FROM frames GROUP BY 1),
fixed AS (SELECT recording_id, band, hits, frames FROM (SELECT recording_id, CAST(floor(y / 20 + 0.5) AS BIGINT) AS band, count(DISTINCT frame_idx) AS hits FROM obs GROUP BY 1, 2)
  JOIN total USING (recording_id) WHERE frames > 1 AND hits / frames >= 0.8),
keyed AS (SELECT *, {normalized("text")} AS key, CAST(floor(y / 20 + 0.5) AS BIGINT) AS band FROM obs),
open_lines AS (SELECT * FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.recording_id = k.recording_id AND f.band = k.band)),
content AS (SELECT * FROM open_lines WHERE length(key) > 0),
keys AS (SELECT * FROM open_lines WHERE length(key) >= 4),
single AS (SELECT recording_id, frame_idx, key, any_value(line_no) AS line_no, any_value(y) AS y FROM keys GROUP BY 1, 2, 3 HAVING count(*) = 1),
exact AS (SELECT c.recording_id, c.frame_idx AS pair_idx, p.line_no AS prev_line, c.line_no AS cur_line, p.y - c.y AS diff
  FROM keys c JOIN single p ON p.recording_id = c.recording_id AND p.frame_idx + 1 = c.frame_idx AND p.key = c.key),
near AS (SELECT *, 1 - far / longest AS similarity FROM (
    SELECT p.recording_id, c.frame_idx AS pair_idx, p.line_no AS prev_line, c.line_no AS cur_line, p.y - c.y AS diff,
      greatest(length(p.key), length(c.key)) AS longest, levenshtein({plain("p.key")}, {plain("c.key")}) AS far
    FROM keys p JOIN keys c ON c.recording_id = p.recording_id AND c.frame_idx = p.frame_idx + 1
    WHERE least(length(p.key), length(c.key)) >= greatest(length(p.key), length(c.key)) * 0.9 - 1e-9
      AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.recording_id = p.recording_id AND e.pair_idx = p.frame_idx + 1 AND e.prev_line = p.line_no)
      AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.recording_id = c.recording_id AND e.pair_idx = c.frame_idx AND e.cur_line = c.line_no))
  WHERE 1 - far / longest >= 0.9),
fuzzy AS (SELECT recording_id, pair_idx, prev_line, cur_line, diff, similarity FROM (SELECT *,
    row_number() OVER a = 1 AND coalesce(lead(similarity) OVER a < similarity, true) AS one, row_number() OVER b = 1 AND coalesce(lead(similarity) OVER b < similarity, true) AS other
  FROM near WINDOW a AS (PARTITION BY recording_id, pair_idx, prev_line ORDER BY similarity DESC), b AS (PARTITION BY recording_id, pair_idx, cur_line ORDER BY similarity DESC)) WHERE one AND other),
{clusters("own", "exact", "recording_id, pair_idx")},
shifts AS (SELECT f.recording_id, CAST(f.frame_idx AS INTEGER) AS pair_idx, coalesce(members[votes // 2 + 1], 0) AS shift, coalesce(votes, 0) AS votes, coalesce(total, 0) AS total
  FROM frames f LEFT JOIN own b ON b.recording_id = f.recording_id AND b.pair_idx = f.frame_idx WHERE f.frame_idx > 0),
{moved("moved", "shifts")}"""


def moved(name: str, shifts: str) -> str:
    return f"""{name} AS (SELECT *, sum(shift) OVER w AS cumulative_shift, CAST(sum(CASE WHEN total >= 3 AND votes / total >= 0.4 THEN 0 ELSE 1 END) OVER w AS BIGINT) AS segment_id
  FROM {shifts} WINDOW w AS (PARTITION BY recording_id ORDER BY pair_idx ROWS UNBOUNDED PRECEDING))"""


#: The anchor plan over misread recordings, with fuzzy anchors: up to ``table_`` and ``placed``.
RUN = anchors(MISREAD) + f""",
evidence AS (SELECT recording_id, pair_idx, diff FROM exact UNION ALL SELECT recording_id, pair_idx, diff FROM fuzzy),
{clusters("joint", "evidence", "recording_id, pair_idx")},
state AS (SELECT *, NOT sure AND jv >= 3 AND jv / jt >= 0.6 AND coalesce(jv > jr, true) AS rescue FROM (
    SELECT j.recording_id, j.pair_idx, o.members AS om, j.members AS jm, coalesce(o.votes, 0) AS ov, coalesce(o.total, 0) AS ot, j.votes AS jv, j.total AS jt, j.runner_up AS jr,
      coalesce(o.total >= 3 AND o.votes / o.total >= 0.4, false) AS sure FROM joint j LEFT JOIN own o USING (recording_id, pair_idx))),
taken AS (SELECT f.recording_id, f.pair_idx, f.diff, sure FROM fuzzy f JOIN state USING (recording_id, pair_idx)
  WHERE len(list_filter(CASE WHEN sure THEN om WHEN rescue THEN jm ELSE [] END, lambda m: abs(m - f.diff) <= 3)) > 0),
wider AS (SELECT recording_id, pair_idx, diff FROM taken WHERE sure
  UNION ALL SELECT recording_id, pair_idx, diff FROM exact SEMI JOIN (SELECT recording_id, pair_idx FROM taken WHERE sure) USING (recording_id, pair_idx)),
{clusters("wide", "wider", "recording_id, pair_idx")},
offered AS (SELECT recording_id, pair_idx, count(*) AS n FROM fuzzy GROUP BY ALL),
accepted AS (SELECT recording_id, pair_idx, count(*) AS n FROM taken GROUP BY ALL),
table_ AS (SELECT f.recording_id, CAST(f.frame_idx AS INTEGER) AS pair_idx, coalesce(CASE WHEN rescue THEN jm[jv // 2 + 1] ELSE om[ov // 2 + 1] END, 0) AS shift,
    coalesce(w.votes, CASE WHEN rescue THEN jv ELSE ov END, 0) AS votes, coalesce(w.total, CASE WHEN rescue THEN jt ELSE ot END, 0) AS total, coalesce(ot, 0) AS exact_total,
    coalesce(o.n, 0) AS fuzzy_candidates, coalesce(a.n, 0) AS fuzzy_accepted, coalesce(o.n, 0) - coalesce(a.n, 0) AS fuzzy_rejected, coalesce(rescue, false) AS fuzzy_rescue,
    CASE WHEN sure THEN 0 ELSE coalesce(jv, 0) END AS candidate_votes, CASE WHEN sure THEN 0 ELSE coalesce(jt, 0) END AS candidate_total
  FROM frames f LEFT JOIN state s ON s.recording_id = f.recording_id AND s.pair_idx = f.frame_idx LEFT JOIN wide w ON w.recording_id = f.recording_id AND w.pair_idx = f.frame_idx
    LEFT JOIN offered o ON o.recording_id = f.recording_id AND o.pair_idx = f.frame_idx LEFT JOIN accepted a ON a.recording_id = f.recording_id AND a.pair_idx = f.frame_idx WHERE f.frame_idx > 0),
{moved("moved_all", "table_")},
placed AS (SELECT c.*, c.y + coalesce(cumulative_shift, 0) AS gy, coalesce(segment_id, 0) AS segment_id
  FROM content c LEFT JOIN moved_all m ON m.recording_id = c.recording_id AND m.pair_idx = c.frame_idx)"""

NEW = "struct_pack(g := {g}, gy := o.gy, x := o.x, w := o.w, h := o.h, frame := o.frame_idx, size := length(o.text))"
#: Groups of sightings and the line that stands for each, from ``placed``.
CHOSEN = RUN + f""",
taking AS (SELECT *, row_number() OVER (PARTITION BY recording_id, segment_id ORDER BY gy, x, frame_idx, line_no) AS i FROM placed),
sight AS (
  SELECT recording_id, segment_id, i, 0 AS g, 1 AS n, [{NEW.format(g=0)}] AS tops FROM taking o WHERE i = 1
  UNION ALL
  SELECT recording_id, segment_id, i, coalesce(hit, n) AS g, CASE WHEN hit IS NULL THEN n + 1 ELSE n END AS n,
    CASE WHEN hit IS NULL THEN list_append(tops, new) ELSE list_transform(tops, lambda t: CASE WHEN t.g = hit AND t.size < new.size THEN new ELSE t END) END AS tops
  FROM (SELECT o.recording_id, o.segment_id, o.i, s.n, {NEW.format(g="coalesce(hit, s.n)")} AS new, hit, list_filter(s.tops, lambda t: t.gy >= o.gy - 90) AS tops
    FROM (SELECT s.*, list_max(list_transform(list_filter(s.tops, lambda t: abs(t.gy - o.gy) <= 90 AND t.frame <> o.frame_idx
          AND coalesce(greatest(least(t.x + t.w, o.x + o.w) - greatest(t.x, o.x), 0) * greatest(least(t.gy + t.h, o.gy + o.h) - greatest(t.gy, o.gy), 0) / nullif(least(t.w * t.h, o.w * o.h), 0), 0) >= 0.6),
          lambda t: t.g)) AS hit, o.i AS next FROM sight s JOIN taking o ON o.recording_id = s.recording_id AND o.segment_id = s.segment_id AND o.i = s.i + 1) s
    JOIN taking o ON o.recording_id = s.recording_id AND o.segment_id = s.segment_id AND o.i = s.next)),
members AS (SELECT t.*, g, row_number() OVER (PARTITION BY t.recording_id, t.segment_id, g ORDER BY length(text) DESC, t.i) = 1 AS longest,
    row_number() OVER (PARTITION BY t.recording_id, t.segment_id, g ORDER BY t.i) = 1 AS head FROM taking t JOIN sight s ON s.recording_id = t.recording_id AND s.segment_id = t.segment_id AND s.i = t.i),
seen AS (SELECT recording_id, segment_id, g, frame_idx, count(*) AS n_parts, string_agg(text, '' ORDER BY x, i, text) AS text, string_agg(text, ' ' ORDER BY x, i, text) AS spaced, min(x) AS x, min(gy) AS gy,
  FROM members GROUP BY ALL),
variants AS (SELECT recording_id, segment_id, g, {normalized("text")} AS norm, count(*) AS n, min(frame_idx) AS first_frame,
    arg_min(struct_pack(text, spaced, x, gy, frame_idx), struct_pack(a := n_parts > 1, b := frame_idx)) AS proposed, count(*) FILTER (n_parts > 1) AS n_composed, sum(n_parts) AS n_sightings FROM seen GROUP BY ALL),
per_group AS (SELECT recording_id, segment_id, g, arg_max(struct_pack(n, norm, proposed), struct_pack(n, b := -first_frame)) AS best, sum(n) AS n_frames, sum(n_composed) AS n_composed, sum(n_sightings) AS n_sightings
  FROM variants GROUP BY ALL),
longest AS (SELECT recording_id, segment_id, g, struct_pack(text, spaced := text, x, gy, frame_idx) AS line, key AS norm FROM members WHERE longest),
heads AS (SELECT recording_id, segment_id, g, frame_idx AS rank_frame, line_no AS rank_line, gy AS rank_gy, x AS rank_x FROM members WHERE head),
judged AS (SELECT *, CASE WHEN NOT majority THEN 'longer-fallback' WHEN best.norm <> norm AND 1 - levenshtein({plain("best.norm")}, {plain("norm")}) / greatest(length(best.norm), length(norm)) < 0.8
      THEN 'unrelated-majority-rejected' ELSE 'strict-majority' END AS kind
  FROM (SELECT *, n_frames >= 3 AND best.n >= 3 AND best.n * 2 > n_frames AS majority FROM per_group JOIN longest USING (recording_id, segment_id, g) JOIN heads USING (recording_id, segment_id, g))),
chosen AS (SELECT * EXCLUDE (line), line.text AS longer_text, CASE WHEN kind = 'strict-majority' THEN best.proposed ELSE line END AS line FROM judged)"""
STATS = f"""
stats AS (SELECT recording_id, count(*) FILTER (n_sightings > 1) AS candidate_groups, CAST(sum(n_sightings) AS BIGINT) AS observations, CAST(sum(n_frames) AS BIGINT) AS frame_observations,
  count(*) FILTER (n_composed > 0) AS composed_clusters, count(*) FILTER (n_frames >= 3) AS majority_eligible, count(*) FILTER (kind = 'strict-majority') AS majority_chosen,
  count(*) FILTER (kind = 'unrelated-majority-rejected') AS majority_rejected, count(*) FILTER (kind = 'strict-majority' AND line.text <> longer_text) AS changed,
  count(*) FILTER (kind = 'strict-majority' AND {normalized("line.text")} <> {normalized("longer_text")}) AS normalized_changed,
  count(*) FILTER (kind <> 'strict-majority' AND n_sightings > 1) AS longer_fallback FROM chosen GROUP BY 1)"""


def rows(name: str, source: str, at: str, order: str) -> str:
    """``name(recording_id, row_no, text)``: visual rows of ``source(recording_id, text, x, at, …)``."""
    return f"""
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY {at}, {order}) AS i FROM {source}),
{name}_w AS (SELECT recording_id, i, {at} AS first, 0 AS row_no FROM {name}_o WHERE i = 1
  UNION ALL SELECT o.recording_id, o.i, CASE WHEN o.{at} - w.first < 18 THEN w.first ELSE o.{at} END, CASE WHEN o.{at} - w.first < 18 THEN row_no ELSE row_no + 1 END
  FROM {name}_w w JOIN {name}_o o ON o.recording_id = w.recording_id AND o.i = w.i + 1),
{name} AS (SELECT recording_id, row_no, string_agg(text, ' ' ORDER BY x, i) AS text FROM {name}_o JOIN {name}_w USING (recording_id, i) GROUP BY ALL)"""


def unrepeated(name: str, source: str, order: str, least: int = 8) -> str:
    """``name``: the rows of ``source(recording_id, order, text)`` whose trimmed text is not among the last 40 kept."""
    return f"""
{name}_o AS (SELECT *, md5({trimmed("text")}) AS t, {units(trimmed("text"))} AS u, row_number() OVER (PARTITION BY recording_id ORDER BY {order}) AS i FROM {source}),
{name}_w AS (SELECT recording_id, i, true AS stays, [t] AS recent FROM {name}_o WHERE i = 1
  UNION ALL SELECT recording_id, i, stays, CASE WHEN stays THEN list_append(recent, t)[-40:] ELSE recent END FROM (
    SELECT o.recording_id, o.i, o.t, w.recent, NOT (o.u >= {least} AND list_contains(w.recent, o.t)) AS stays FROM {name}_w w JOIN {name}_o o ON o.recording_id = w.recording_id AND o.i = w.i + 1)),
{name} AS (SELECT o.* EXCLUDE (t, u, i) FROM {name}_o o JOIN {name}_w w USING (recording_id, i) WHERE stays)"""


def spaced(name: str, source: str) -> str:
    """``name(recording_id, slot, line_no, text, x, y, side)``: spatial dedupe of ``source(recording_id, line_no, text, x, y, side)``."""
    return f"""
{name}_o AS (SELECT * EXCLUDE (trim_text) REPLACE (trim_text AS text), row_number() OVER (PARTITION BY recording_id ORDER BY y, x, line_no) AS i
  FROM (SELECT *, {trimmed("text")} AS trim_text FROM {source}) WHERE length(trim_text) > 0),
{name}_w AS (
  SELECT recording_id, i, line_no AS slot, [struct_pack(slot := line_no, x, y, size := length(text))] AS tops FROM {name}_o WHERE i = 1
  UNION ALL
  SELECT recording_id, i, coalesce(hit.slot, new.slot), CASE WHEN hit IS NULL THEN list_append(tops, new)
      ELSE list_transform(tops, lambda t: CASE WHEN t.slot = hit.slot AND t.size < new.size THEN struct_pack(slot := t.slot, x := new.x, y := new.y, size := new.size) ELSE t END) END
  FROM (SELECT o.recording_id, o.i, struct_pack(slot := o.line_no, x := o.x, y := o.y, size := length(o.text)) AS new, list_filter(w.tops, lambda t: t.y > o.y - 20) AS tops,
      list_filter(w.tops, lambda t: abs(t.y - o.y) < 20 AND abs(t.x - o.x) < 40)[1] AS hit FROM {name}_w w JOIN {name}_o o ON o.recording_id = w.recording_id AND o.i = w.i + 1)),
{name} AS (SELECT * EXCLUDE (best) FROM (SELECT o.* EXCLUDE (i), slot, row_number() OVER (PARTITION BY recording_id, slot ORDER BY length(text) DESC, i) AS best FROM {name}_o o JOIN {name}_w USING (recording_id, i)) WHERE best = 1)"""


#: Chat lines, their peaks, bubbles and bubbles' rows.
SEQS = """
parts AS (SELECT conv_id AS recording_id, turn, role, i - 1 AS part, p[i] AS text FROM (SELECT *, string_split(text, chr(10)) AS p FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL), unnest(range(1, len(p) + 1)) AS u(i)),
seqs AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY turn, part, role, text) - 1 AS INTEGER) AS seq, CAST(least(20 * length(text), 451) AS DOUBLE) AS w
  FROM parts WHERE trim(text, ' ') <> ''),
plain_chat AS (SELECT *, CASE WHEN role = 'user' THEN 585 - w ELSE 134 END AS x, CAST(70 * turn + 40 * seq AS DOUBLE) AS gy, 30::DOUBLE AS h FROM seqs)"""
PEAKS = """
width AS (SELECT recording_id, greatest(max(x + w), 1) AS width FROM chat GROUP BY 1),
peaks AS (SELECT recording_id,
    (SELECT x FROM (SELECT x, count(*) AS n, min(seq) AS seen FROM chat c WHERE c.recording_id = t.recording_id AND length(text) >= 2 AND x < width / 2 GROUP BY 1) ORDER BY n DESC, seen LIMIT 1) AS left_peak,
    (SELECT r FROM (SELECT x + w AS r, count(*) AS n, min(seq) AS seen FROM chat c WHERE c.recording_id = t.recording_id AND length(text) >= 2 AND x + w > width / 2 GROUP BY 1) ORDER BY n DESC, seen LIMIT 1) AS right_peak
  FROM width t)"""
CHAT = SEQS + ", chat AS (SELECT *, seq // 4 AS frame_idx FROM plain_chat)," + PEAKS
#: The same with display names above most of the others' turns.
NAMED_CHAT = SEQS + """,
flagged AS (SELECT *, row_number() OVER (PARTITION BY recording_id, turn, role ORDER BY seq) = 1 AND role = 'assistant' AND (recording_id + turn) % 5 <> 4 AS named FROM plain_chat),
chat AS (SELECT *, seq // 4 AS frame_idx FROM (
  SELECT recording_id, turn, role, text, CAST(2 * seq + 1 AS INTEGER) AS seq, w, CASE WHEN named AND turn % 2 = 1 THEN 128 ELSE x END AS x, gy, CASE WHEN named AND turn % 2 = 1 THEN 34 ELSE h END AS h FROM flagged
  UNION ALL SELECT recording_id, turn, role, '友' || (turn % 4), CAST(2 * seq AS INTEGER), 40, 114, gy - 50, 16 + 4 * (turn % 4) FROM flagged WHERE named)),""" + PEAKS
TIME = f"regexp_matches({trimmed('text')}, '^(昨天[{WHITE}]*)?[0-9]{{1,2}}[:：][0-9]{{2}}$')"
BUBBLE_STEPS = f""",
shown AS (SELECT *, gy % 1600 AS y, row_number() OVER (PARTITION BY recording_id ORDER BY gy, seq) AS i FROM (
    SELECT *, coalesce(abs(x - left_peak) <= 30, false) AS left_hit, coalesce(abs(x + w - right_peak) <= 30, false) AS right_hit FROM chat JOIN peaks USING (recording_id)) WHERE (left_hit OR right_hit) AND NOT {TIME}),
walk AS (
  SELECT recording_id, i, 0 AS g, 1 AS n, [struct_pack(g := 0, bottom := gy, lefts := x)] AS tops FROM shown WHERE i = 1
  UNION ALL
  SELECT recording_id, i, coalesce(-hit.g, n), CASE WHEN hit IS NULL THEN n + 1 ELSE n END, CASE WHEN hit IS NULL THEN list_append(tops, struct_pack(g := n, bottom := gy, lefts := x))
      ELSE list_transform(tops, lambda t: CASE WHEN t.g = -hit.g THEN struct_pack(g := t.g, bottom := greatest(t.bottom, gy), lefts := x) ELSE t END) END
  FROM (SELECT o.recording_id, o.i, o.gy, o.x, w.n, list_filter(w.tops, lambda t: t.bottom > o.gy - 62) AS tops,
      list_min(list_transform(list_filter(w.tops, lambda t: o.gy - t.bottom >= 0 AND o.gy - t.bottom < 62 AND abs(o.x - t.lefts) < 60),
        lambda t: struct_pack(dy := o.gy - t.bottom, dx := abs(o.x - t.lefts), g := -t.g))) AS hit
    FROM walk w JOIN shown o ON o.recording_id = w.recording_id AND o.i = w.i + 1)),
rows AS (SELECT s.*, g, row_number() OVER (PARTITION BY recording_id, g ORDER BY gy, x, i) - 1 AS row_no FROM shown s JOIN walk USING (recording_id, i)),
bubbles AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY first_seq) - 1 AS bubble_no,
    CASE WHEN l AND r THEN NULL WHEN r THEN 'me' ELSE 'them' END AS label, CASE WHEN l AND r THEN 'pixel-pending' WHEN r THEN 'definite-right' ELSE 'definite-left' END AS kind
  FROM (SELECT recording_id, g, min(seq) AS first_seq, min(gy) AS gy, string_agg(text, '' ORDER BY row_no) AS text, bool_or(left_hit) AS l, bool_or(right_hit) AS r,
    arg_max(struct_pack(frame_idx, x, y, w), struct_pack(a := w * h, b := -row_no)) AS sample FROM rows GROUP BY 1, 2))"""
BUBBLES = CHAT + BUBBLE_STEPS
#: The same where some turns reach over the whole width.
WIDE_BUBBLES = SEQS + """, chat AS (SELECT recording_id, turn, role, text, seq, CASE WHEN wide THEN 451 ELSE w END AS w, CASE WHEN wide THEN 134 ELSE x END AS x,
    CASE WHEN wide THEN CAST(70 * turn + CASE WHEN turn % 2 = 0 THEN 30 * (seq % 3) ELSE 0 END AS DOUBLE) ELSE gy END AS gy, h, seq // 4 AS frame_idx
  FROM (SELECT *, role = 'user' AND (recording_id + turn) % 3 = 0 AS wide FROM plain_chat)),""" + PEAKS + BUBBLE_STEPS
#: Bubbles with the samples that the query derives from their numbers, and the messages that display names cut them into.
RESOLVED = NAMED_CHAT + BUBBLE_STEPS + """,
answered AS (SELECT *, kind = 'pixel-pending' AS pending, bubble_no % 7 <> 0 AS given, CASE bubble_no * 37 % 90 % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'them' END AS said FROM bubbles),
nicked AS (SELECT *, CASE WHEN common AND body BETWEEN -2 AND 2 AND bh BETWEEN 26 AND 37 AND dx >= 14 THEN 1 WHEN common AND body BETWEEN -11 AND -3 AND bh BETWEEN 31 AND 37 AND bh - h >= 5 AND dx >= 7 THEN 2 END AS nick FROM (
    SELECT *, lead(x) OVER w - left_peak AS body, lead(h) OVER w AS bh, lead(x) OVER w - x AS dx,
      left_hit AND NOT right_hit AND lead(left_hit) OVER w AND left_peak - x BETWEEN 14 AND 30 AND h BETWEEN 16 AND 27 AND lead(gy) OVER w - gy BETWEEN 44 AND 56 AS common
    FROM rows WINDOW w AS (PARTITION BY recording_id, g ORDER BY row_no))),
split AS (SELECT *, count(*) FILTER (nick IS NOT NULL AND row_no > 0) OVER (PARTITION BY recording_id, g ORDER BY row_no) AS segment_no FROM nicked),
segments AS (SELECT recording_id, g, segment_no, string_agg(text, '' ORDER BY row_no) AS text, arg_min(text, row_no) AS first_text, coalesce(string_agg(text, '' ORDER BY row_no) FILTER (row_no > start), '') AS body,
  max(nick) FILTER (row_no = start) AS nick FROM (SELECT *, min(row_no) OVER (PARTITION BY recording_id, g, segment_no) AS start FROM split) GROUP BY 1, 2, 3),
resolved AS (SELECT recording_id, g, bubble_no, text, coalesce(label, CASE WHEN given THEN said END) AS label, pending AND (NOT given OR said IS NULL) AS warned, pending AND NOT given AS failed,
  CASE WHEN pending AND given AND bubble_no % 2 = 0 THEN 13 * bubble_no + 5 ELSE 0 END AS decoded, CASE WHEN pending AND given THEN 7 * bubble_no ELSE 0 END AS sampled,
  CASE WHEN NOT pending THEN kind WHEN NOT given THEN 'pixel-error' WHEN said IS NOT NULL THEN 'pixel-color' ELSE 'pixel-unresolved' END AS kind FROM answered)"""

#: Where each frame's view starts on the page, and the pixels of views and previews, as the queries derive them.
POSITIONS = frames() + """,
placed AS (SELECT recording_id, frame_idx, CAST(sum(CASE WHEN frame_idx = 0 THEN 100 ELSE 4 * ((7 * recording_id + 20 * frame_idx) % 30 - 5) END)
  OVER (PARTITION BY recording_id ORDER BY frame_idx) AS BIGINT) AS position FROM frames)"""


def page(recording: str, row: str, column: str = "0") -> str:
    return f"((7 * {row} * {row} + 31 * {row} + 13 * {recording}) % 251 + {column})"


def pixels(rows: str, columns: str) -> str:
    """``pixels(recording_id, frame_idx, y, x, r, g, b)`` for ranges of rows and columns of all views."""
    return f"""
pixels AS (SELECT recording_id, frame_idx, y, x, v % 256 AS r, 3 * v % 256 AS g, (5 * v + 7) % 256 AS b FROM (
  SELECT recording_id, frame_idx, y, x, CASE WHEN frame_idx % 3 = 1 AND y % 28 = 12 THEN 17 * x + 5 * frame_idx % 200 ELSE {page('recording_id', '(y + position)', 'x')} END AS v
  FROM placed, unnest({rows}) AS a(y), unnest({columns}) AS b(x)))"""


#: The coarse search in full: every template row against every place.
PIXEL_SHIFTS = POSITIONS + f""", {pixels("range(8, 472, 4)", "range(0, 4, 4)")},
coarse AS (SELECT recording_id, frame_idx, (y - 8) // 4 AS i, (77 * r + 150 * g + 29 * b) // 256 AS v FROM pixels),
sums AS (SELECT n.recording_id, n.frame_idx, o.i - n.i + 15 AS t, sum(abs(o.v - n.v)) AS s FROM coarse n JOIN coarse o ON o.recording_id = n.recording_id AND o.frame_idx = n.frame_idx - 1
    AND o.i BETWEEN n.i - 15 AND n.i + 26 WHERE n.i >= 15 AND n.i < 90 GROUP BY ALL),
shifts AS (SELECT recording_id, CAST(frame_idx AS INTEGER) AS pair_idx, CAST(4 * best.t - 60 AS INTEGER) AS dy, 1 - least(1, CAST(best.s AS DOUBLE) / 4800) AS conf
  FROM (SELECT recording_id, frame_idx, min(struct_pack(s, t)) AS best FROM sums GROUP BY 1, 2))"""

def regions(shown: str, height: int) -> str:
    """``found(recording_id, high, seen, top, bottom)``: what scrolls, from ``spread(recording_id, y, s)``, which ``shown`` makes."""
    return f"""{shown},
cut AS (SELECT recording_id, greatest(10, p85 * 0.7::DOUBLE) AS high, greatest(4, p85 * 0.28::DOUBLE) AS low FROM (SELECT recording_id, list(s ORDER BY s)[{int(height * 0.85) + 1}] AS p85 FROM spread GROUP BY 1)),
run AS (SELECT recording_id, min(y) AS top, max(y) + 1 AS bottom FROM (SELECT recording_id, y, y - row_number() OVER (PARTITION BY recording_id ORDER BY y) AS island FROM spread JOIN cut USING (recording_id) WHERE s >= high)
  GROUP BY recording_id, island),
seed AS (SELECT recording_id, arg_max(struct_pack(top, bottom), struct_pack(n := bottom - top, first := -top)) AS seed FROM run GROUP BY 1),
grown AS (SELECT recording_id, y, seed, CASE WHEN y < seed.top THEN 'up' ELSE 'down' END AS way, CASE WHEN y < seed.top THEN seed.top - 1 - y ELSE y - seed.bottom END AS away
  FROM spread JOIN cut USING (recording_id) JOIN seed USING (recording_id) WHERE s >= low AND (y < seed.top OR y >= seed.bottom)),
gaps AS (SELECT *, away - coalesce(lag(away) OVER (PARTITION BY recording_id, way ORDER BY away), -1) - 1 >= 40 AS far FROM grown),
near AS (SELECT *, bool_or(far) OVER (PARTITION BY recording_id, way ORDER BY away) AS past FROM gaps),
ends AS (SELECT recording_id, coalesce(min(y), {height}) AS top, coalesce(max(y), -1) + 1 AS bottom FROM near WHERE NOT past GROUP BY 1),
found AS (SELECT c.recording_id, high, seed IS NOT NULL AS seen, least(seed.top, coalesce(e.top, {height})) AS top, greatest(seed.bottom, coalesce(e.bottom, 0)) AS bottom
  FROM cut c LEFT JOIN seed USING (recording_id) LEFT JOIN ends e USING (recording_id))"""


def key_frames(limit: str, view: str, views: str = "(SELECT DISTINCT recording_id FROM moved)") -> str:
    """``kept(recording_id, k)``, ``steps(…, keep_no, wide)`` and ``bounced`` from ``moved(recording_id, k, dy)``; ``views`` has what ``limit`` and ``view`` name."""
    return f"""
settled AS (SELECT recording_id, k, dy, sum(greatest(dy, 0)) OVER w AS place, max(CASE WHEN dy < 0 THEN 0 ELSE k END) OVER w AS solid FROM moved WINDOW w AS (PARTITION BY recording_id ORDER BY k)),
known AS (SELECT s.*, t.place AS solid_place, lag(s.solid) OVER w AS before, lag(t.place) OVER w AS before_place FROM settled s JOIN settled t ON t.recording_id = s.recording_id AND t.k = s.solid
  WINDOW w AS (PARTITION BY s.recording_id ORDER BY s.k)),
walk AS (SELECT recording_id, k, 0 AS last, place AS last_place FROM known WHERE k = 0
  UNION ALL SELECT n.recording_id, n.k, CASE WHEN n.place - w.last_place > {limit} AND before > w.last THEN before WHEN n.place - w.last_place > {limit} AND solid > w.last THEN solid ELSE w.last END,
    CASE WHEN n.place - w.last_place > {limit} AND before > w.last THEN before_place WHEN n.place - w.last_place > {limit} AND solid > w.last THEN solid_place ELSE w.last_place END
  FROM walk w JOIN known n ON n.recording_id = w.recording_id AND n.k = w.k + 1 JOIN {views} AS v ON v.recording_id = n.recording_id),
kept AS (SELECT DISTINCT recording_id, last AS k FROM walk UNION SELECT recording_id, max(solid) FROM known GROUP BY 1),
steps AS (SELECT recording_id, k, row_number() OVER w - 1 AS keep_no, place - lag(place) OVER w >= {view} AS wide FROM kept JOIN settled USING (recording_id, k) JOIN {views} AS v USING (recording_id)
  WINDOW w AS (PARTITION BY recording_id ORDER BY k)),
bounced AS (SELECT recording_id, count(*) FILTER (dy < 0) AS dropped FROM moved GROUP BY 1)"""


def screen(row: str, column: str) -> str:
    return f"(((7 + {row} // 251) * {row} * {row} + 31 * {row} + 13 * recording_id) % 251 + {column})"


def shade(v: str, *weights: int) -> str:
    return "(" + " + ".join(f"{w} * ({part} % 256)" for w, part in zip(weights, (v, f"(3 * {v})", f"(5 * {v} + 7)"))) + ")"


#: Rows' spread over all frames of the small previews.
PREVIEW_SPREAD = f"""shown AS (SELECT recording_id, frame_idx, y, CASE WHEN y < 24 OR y >= 188 OR (y >= 70 AND y < 70 + recording_id % 60) THEN {page('recording_id', 'y')} ELSE {page('recording_id', '(y + position)')} END AS v,
    max(frame_idx) OVER (PARTITION BY recording_id) + 1 AS n FROM placed, unnest(range(0, 200)) AS a(y)),
spread AS (SELECT recording_id, y, sqrt(greatest(0, sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)))) AS s FROM shown WHERE frame_idx >= floor(n * 0.4::DOUBLE) GROUP BY 1, 2)"""

#: Rows' spread over the preview frames; a frame picked several times counts as often.
SCREEN_SPREAD = f"""picked AS (SELECT recording_id, CAST(floor(i * (n - 1) / 23 + 0.5) AS INTEGER) AS frame_idx, i FROM (SELECT DISTINCT recording_id, n FROM screens), unnest(range(9, 24)) AS u(i)),
times AS (SELECT recording_id, frame_idx, count(*) AS times FROM picked GROUP BY ALL),
thin AS (SELECT recording_id, y, x, times, {shade('v', 77, 150, 29)} // 256 AS g FROM (
  SELECT recording_id, y, x, times, {screen('(CASE WHEN y < 40 OR y >= 1000 THEN y ELSE y + position END)', 'x')} AS v FROM screens JOIN times USING (recording_id, frame_idx), unnest(range(0, 1040)) AS a(y), (VALUES (0), (4)) AS b(x))),
spread AS (SELECT recording_id, y, avg(s) AS s FROM (SELECT recording_id, y, x, sqrt(greatest(0, sum(times * g * g) / 15 - (sum(times * g) / 15) * (sum(times * g) / 15))) AS s FROM thin GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

#: The stitch plan: region and neighbours' scroll are searched pixel by pixel. Where a key frame lies under the last one placed
#: is known from the pages: it is found if the template is in that frame, and unsure otherwise.
STITCH = f"""{LINES},
screens AS (SELECT recording_id, n, CAST(i AS INTEGER) AS frame_idx, CAST(sum(CASE WHEN i = 0 THEN 400 WHEN recording_id % 3 = 0 AND i % 7 = 5 THEN 2400 ELSE 24 * ((7 * recording_id + 20 * i) % 30 - 5) END)
  OVER (PARTITION BY recording_id ORDER BY i) AS BIGINT) AS position FROM (SELECT recording_id, count(*) // 2 + 1 AS n FROM lines GROUP BY 1), unnest(range(0, n)) AS u(i)),
{regions(SCREEN_SPREAD, 1040)},
views AS (SELECT recording_id, CAST(top AS INTEGER) AS top, CAST(bottom AS INTEGER) AS bottom, CAST(bottom - top AS INTEGER) AS vh FROM found WHERE seen AND bottom - top >= 312),
coarse AS (SELECT recording_id, frame_idx, i, x, vh // 4 AS n, {shade('v', 77, 150, 29)} // 256 AS g FROM (
  SELECT recording_id, frame_idx, i, x, vh, {screen('(top + 4 * i + position)', 'x')} AS v FROM screens JOIN views USING (recording_id), unnest(range(0, vh // 4)) AS a(i), (VALUES (0), (4)) AS b(x))),
sums AS (SELECT c.recording_id, c.frame_idx, o.i - c.i + 15 AS t, sum(abs(o.g - c.g)) AS s FROM coarse c JOIN coarse o ON o.recording_id = c.recording_id AND o.frame_idx = c.frame_idx - 1 AND o.x = c.x
    AND o.i BETWEEN c.i - 15 AND c.i - 15 + c.n - 75 WHERE c.i >= 15 AND c.i < 90 GROUP BY ALL),
shifts AS (SELECT recording_id, frame_idx AS k, 4 * best.t - 60 AS dy FROM (SELECT recording_id, frame_idx, min(struct_pack(s, t)) AS best FROM sums GROUP BY 1, 2)),
moved AS (SELECT recording_id, 0 AS k, 0 AS dy FROM views UNION ALL SELECT * FROM shifts),
{key_frames('vh * 0.6::DOUBLE', 'vh', 'views')},
ordered AS (SELECT recording_id, CAST(keep_no AS INTEGER) AS keep_no, k, position, vh FROM steps JOIN screens s USING (recording_id) JOIN views USING (recording_id) WHERE s.frame_idx = k),
laid AS (SELECT recording_id, keep_no, k, vh, position AS last, 0::BIGINT AS off, 0::BIGINT AS move, true AS sure FROM ordered WHERE keep_no = 0
  UNION ALL SELECT recording_id, keep_no, k, vh, CASE WHEN move > 0 THEN position ELSE last END, off + move, move, sure FROM (
    SELECT o.*, p.last, p.off, o.position - p.last BETWEEN -60 AND o.vh - 360 AS sure,
      CASE WHEN o.position - p.last BETWEEN -60 AND o.vh - 360 THEN greatest(0, o.position - p.last) ELSE CAST(floor(o.vh * 0.95::DOUBLE + 0.5) AS BIGINT) END AS move
    FROM laid p JOIN ordered o ON o.recording_id = p.recording_id AND o.keep_no = p.keep_no + 1)),
shown AS (SELECT recording_id, k, last, off, least(vh, coalesce(lead(off) OVER (PARTITION BY recording_id ORDER BY keep_no) - off, vh)) AS size FROM laid WHERE move > 0 OR keep_no = 0),
sums_of AS (SELECT recording_id, CAST(sum({shade('v', 1, 2, 3)} * ((off + y) % 97 + 1)) AS BIGINT) AS checksum FROM (
  SELECT recording_id, off, y, {screen('(top + y + last)', 'x')} AS v FROM shown JOIN views USING (recording_id), unnest(range(0, size)) AS a(y), unnest(range(0, 8)) AS b(x)) GROUP BY 1),
counted AS (SELECT recording_id, CAST(count(*) AS INTEGER) AS n_key, CAST(count(*) FILTER (move > 0 OR keep_no = 0) AS INTEGER) AS n_placed, CAST(count(*) FILTER (NOT sure) AS INTEGER) AS n_unsure, max(off) AS reach FROM laid GROUP BY 1)
SELECT recording_id, CASE WHEN v.recording_id IS NULL THEN 'no_region' ELSE 'ok' END AS status, CAST(f.n AS INTEGER) AS n_frames, CAST(CASE WHEN seen THEN found.top ELSE 0 END AS INTEGER) AS top, CAST(CASE WHEN seen THEN found.bottom ELSE 1040 END AS INTEGER) AS bottom,
  n_key, CAST(dropped AS INTEGER) AS dropped, CAST(too_far AS INTEGER) AS too_far, n_placed, n_unsure, reach + vh AS height, checksum
FROM found JOIN (SELECT DISTINCT recording_id, n FROM screens) f USING (recording_id) LEFT JOIN views v USING (recording_id) LEFT JOIN bounced USING (recording_id)
  LEFT JOIN (SELECT recording_id, count(*) FILTER (wide) AS too_far FROM steps GROUP BY 1) USING (recording_id) LEFT JOIN counted USING (recording_id) LEFT JOIN sums_of USING (recording_id)"""

SQL = {
    "frame_plan": """
WITH r AS (SELECT doc_id AS recording_id, CAST(n_chars * 7 + 0.5 AS DOUBLE) AS d FROM documents WHERE doc_id IS NOT NULL AND n_chars > 0)
SELECT recording_id, CAST(i AS INTEGER) AS source_idx, least(d - 1, CAST(i * 250 AS DOUBLE)) AS time_ms, i % 5 = 0 AS selected, i % 5 = 0 AS extracted
FROM r, unnest(range(0, greatest(1, CAST(floor(d / 250 + 0.5) AS BIGINT)))) AS u(i)""",
    "uniform_plan": """
WITH r AS (SELECT doc_id AS recording_id, CAST(n_chars * 7 + 0.5 AS DOUBLE) AS d FROM documents WHERE doc_id IS NOT NULL AND n_chars > 0)
SELECT recording_id, CAST(i AS INTEGER) AS idx, floor(i * greatest(0, d - 1) / 11 + 0.5) AS time_ms FROM r, unnest(range(0, 12)) AS u(i)""",
    "preset_requests": """
WITH r AS (SELECT doc_id AS recording_id, CAST(n_chars * 7 + 0.5 AS DOUBLE) AS d, CASE doc_id % 3 WHEN 0 THEN 12 ELSE 24 END AS n, CASE doc_id % 3 WHEN 0 THEN 5 ELSE 3 END AS stride,
    CASE doc_id % 3 WHEN 0 THEN 'chat' ELSE 'plain' END AS mode FROM documents WHERE doc_id IS NOT NULL AND n_chars > 0)
SELECT recording_id, mode, 'prescan' AS purpose, CAST(i AS INTEGER) AS idx, floor(i * greatest(0, d - 1) / (n - 1) + 0.5) AS time_ms, 0.4::DOUBLE AS quality FROM r, unnest(range(0, n)) AS u(i)
UNION ALL SELECT recording_id, mode, 'keyframe', CAST(i AS INTEGER), least(d - 1, CAST(i * 250 AS DOUBLE)), 1.0::DOUBLE
  FROM r, unnest(range(0, greatest(1, CAST(floor(d / 250 + 0.5) AS BIGINT)))) AS u(i) WHERE i % stride = 0""",
    "ocr_segments": """
SELECT doc_id AS image_id, CAST(i AS INTEGER) AS segment, 1200 * i AS top, least(1400, n_chars - 1200 * i) AS height
FROM documents, unnest(range(0, (n_chars - 1) // 1200 + 1)) AS u(i) WHERE doc_id IS NOT NULL AND n_chars >= 1""",
    "scroll_observations": f"""WITH {frames()} SELECT * FROM obs""",
    "fixed_bands": f"""WITH {anchors()} SELECT * FROM fixed""",
    "exact_anchors": f"""WITH {anchors()} SELECT recording_id, pair_idx, prev_line, cur_line, diff FROM exact""",
    "fuzzy_anchors": f"""WITH {anchors(MISREAD)} SELECT recording_id, pair_idx, prev_line, cur_line, similarity FROM fuzzy""",
    "shift_votes": f"""WITH {anchors()} SELECT * FROM shifts""",
    "shift_table": f"""WITH {RUN} SELECT * FROM table_""",
    "frame_placement": f"""WITH {anchors()} SELECT recording_id, pair_idx, cumulative_shift, segment_id FROM moved""",
    "anchor_warnings": f"""WITH {anchors()} SELECT * FROM (SELECT recording_id, pair_idx, CASE WHEN total = 0 THEN 'no_common_text' WHEN total < 3 THEN 'few_anchors'
  WHEN votes / total < 0.4 THEN 'scattered_votes' END AS reason, votes, total FROM shifts) WHERE reason IS NOT NULL""",
    "content_lines": f"""WITH {anchors()} SELECT c.recording_id, count(*) AS n_content, sum(y + coalesce(cumulative_shift, 0)) AS sum_gy
FROM content c LEFT JOIN moved m ON m.recording_id = c.recording_id AND m.pair_idx = c.frame_idx GROUP BY 1""",
    "dedupe_lines": f"""WITH RECURSIVE {CHOSEN} SELECT recording_id, rank_frame, rank_line, kind, line.frame_idx AS frame_idx, line.text AS text, line.x AS x, line.gy AS gy, CAST(n_sightings AS BIGINT) AS n_sightings, CAST(n_frames AS BIGINT) AS n_frames FROM chosen""",
    "dedupe_stats": f"""WITH RECURSIVE {CHOSEN}, {STATS} SELECT * FROM stats""",
    "run_stats": f"""WITH RECURSIVE {CHOSEN}, {STATS},
pairs AS (SELECT recording_id, count(*) AS anchor_pairs, sum(shift) AS cumulative_shift, count(*) FILTER (total < 3 OR votes / total < 0.4) AS warnings FROM table_ GROUP BY 1)
SELECT t.recording_id, t.frames AS frame_count, coalesce(b.n, 0) AS fixed_band_count, coalesce(anchor_pairs, 0) AS anchor_pairs, coalesce(cumulative_shift, 0) AS cumulative_shift,
  coalesce(warnings, 0) AS warnings, coalesce(o.n, 0) AS ocr_lines, coalesce(c.n, 0) AS content_lines, coalesce(u.n, 0) AS unique_lines,
  coalesce(candidate_groups, 0) AS candidate_groups, coalesce(observations, 0) AS observations, coalesce(frame_observations, 0) AS frame_observations, coalesce(composed_clusters, 0) AS composed_clusters,
  coalesce(majority_eligible, 0) AS majority_eligible, coalesce(majority_chosen, 0) AS majority_chosen, coalesce(majority_rejected, 0) AS majority_rejected, coalesce(changed, 0) AS changed,
  coalesce(normalized_changed, 0) AS normalized_changed, coalesce(longer_fallback, 0) AS longer_fallback, coalesce(anchor_pairs, 0) - coalesce(warnings, 0) AS anchor_passed,
  CASE WHEN warnings > 0 THEN 'warning' ELSE 'ok' END AS status
FROM total t LEFT JOIN (SELECT recording_id, count(*) AS n FROM fixed GROUP BY 1) b USING (recording_id) LEFT JOIN pairs USING (recording_id) LEFT JOIN (SELECT recording_id, count(*) AS n FROM obs GROUP BY 1) o USING (recording_id)
  LEFT JOIN (SELECT recording_id, count(*) AS n FROM placed GROUP BY 1) c USING (recording_id) LEFT JOIN (SELECT recording_id, count(*) AS n FROM chosen GROUP BY 1) u USING (recording_id) LEFT JOIN stats USING (recording_id)""",
    "plain_transcripts": f"""WITH RECURSIVE {CHOSEN}, canvas AS (SELECT recording_id, line.gy AS gy, line.x AS x, line.spaced AS text, rank_gy, rank_x, rank_frame, rank_line FROM chosen),
{rows("shown_rows", "canvas", "gy", "x, rank_gy, rank_x, rank_frame, rank_line")}
SELECT recording_id, string_agg(text, chr(10) ORDER BY row_no) AS markdown FROM shown_rows GROUP BY 1""",
    "format_plain": f"""WITH RECURSIVE {LINES},
given AS (SELECT recording_id, line_no, text, CASE WHEN line_no % 5 = 3 THEN 150.0::DOUBLE ELSE 134.0::DOUBLE END AS x, CAST(line_no * 17 + line_no * 7 % 11 AS DOUBLE) AS y, 'self' AS side FROM lines),
{spaced("apart", "given")}, {rows("visual", "apart", "y", "x, slot")}, {unrepeated("fresh", "visual", "row_no")}
SELECT recording_id, string_agg(text, chr(10) ORDER BY row_no) AS markdown FROM fresh GROUP BY 1""",
    "text_dedupe": f"""WITH RECURSIVE {LINES}, {unrepeated("fresh", "lines", "line_no")} SELECT recording_id, count(*) AS n_kept, CAST(sum(line_no) AS BIGINT) AS sum_line_no FROM fresh GROUP BY 1""",
    "spatial_dedupe": f"""WITH RECURSIVE {LINES},
given AS (SELECT recording_id, CAST(line_no AS INTEGER) AS line_no, text, CAST(134 + line_no * 13 % 60 AS DOUBLE) AS x, CAST(line_no * 17 + line_no * 7 % 11 AS DOUBLE) AS y, 'self' AS side FROM lines),
{spaced("apart", "given")} SELECT recording_id, slot, line_no, x, y FROM apart""",
    "align_peaks": f"""WITH {CHAT} SELECT * FROM peaks""",
    "speaker_sides": f"""WITH {CHAT} SELECT recording_id, seq, coalesce(abs(x - left_peak) <= 30, false) AS left_hit, coalesce(abs(x + w - right_peak) <= 30, false) AS right_hit
FROM chat JOIN peaks USING (recording_id)""",
    "bubble_groups": f"""WITH RECURSIVE {BUBBLES} SELECT recording_id, CAST(bubble_no AS INTEGER) AS bubble_no, first_seq, gy, text, label, kind FROM bubbles""",
    "geometry_sides": f"""WITH RECURSIVE {WIDE_BUBBLES}, bands AS (SELECT recording_id, g, count(DISTINCT floor(gy / 20 + 0.5)) FILTER (right_hit) AS n FROM rows GROUP BY 1, 2)
SELECT recording_id, CAST(bubble_no AS INTEGER) AS bubble_no, gy, text, coalesce(label, CASE WHEN n >= 2 THEN 'me' ELSE 'them' END) AS label,
  CASE WHEN label IS NOT NULL THEN kind WHEN n >= 2 THEN 'weak-right-repeat' ELSE 'double-default-left' END AS kind FROM bubbles JOIN bands USING (recording_id, g)""",
    "speaker_stats": f"""WITH RECURSIVE {RESOLVED} SELECT * FROM (SELECT recording_id, count(*) FILTER (kind LIKE 'pixel%') AS dual, count(*) FILTER (kind = 'pixel-color') AS pixel_resolved,
  count(*) FILTER (kind = 'pixel-color' AND label = 'me') AS pixel_me, count(*) FILTER (kind = 'pixel-color' AND label = 'them') AS pixel_them, count(*) FILTER (warned) AS pixel_unresolved,
  count(*) FILTER (failed) AS pixel_errors, CAST(sum(decoded) AS BIGINT) AS decoded_pixels, CAST(sum(sampled) AS BIGINT) AS sampled_pixels FROM resolved GROUP BY 1)
JOIN (SELECT recording_id, count(nick) AS nickname_candidates, count(*) FILTER (nick = 1) AS nickname_high_confidence, count(*) FILTER (nick = 2) AS nickname_wide_body,
  count(*) FILTER (segment_no > 0) AS nickname_internal_splits, count(*) FILTER (nick IS NOT NULL AND label = 'them') AS nickname_applied FROM segments JOIN resolved USING (recording_id, g) GROUP BY 1) USING (recording_id)""",
    "chat_transcripts": f"""WITH RECURSIVE {RESOLVED},
said AS (SELECT recording_id, bubble_no, 0 AS segment_no, '[我] ' || text AS text FROM resolved WHERE label = 'me'
  UNION ALL SELECT recording_id, bubble_no, segment_no, CASE WHEN nick IS NULL THEN '[对方] ' || s.text ELSE '[' || first_text || '] ' || body END FROM resolved JOIN segments s USING (recording_id, g) WHERE label = 'them')
SELECT recording_id, string_agg(text, chr(10) ORDER BY bubble_no, segment_no) AS markdown FROM said GROUP BY 1""",
    "region_requests": f"""WITH RECURSIVE {BUBBLES}, b AS (SELECT recording_id, bubble_no, sample.frame_idx AS frame_idx, sample.x - 140.25 AS x, sample.y + 0.5 AS y, sample.w AS w FROM bubbles WHERE l AND r)
SELECT recording_id, 'bubble-' || bubble_no AS id, CAST(bubble_no AS INTEGER) AS bubble_no, frame_idx, 'f_' || lpad(CAST(frame_idx + 1 AS VARCHAR), 4, '0') || '.jpg' AS uri,
  CAST(greatest(0, floor(x)) AS BIGINT) AS x, CAST(greatest(0, floor(y)) AS BIGINT) AS y,
  CAST(ceil(x + w) - greatest(0, floor(x)) AS BIGINT) AS width, CAST(ceil(y + 30) - greatest(0, floor(y)) AS BIGINT) AS height FROM b""",
    "format_chat": f"""WITH RECURSIVE {CHAT},
given AS (SELECT recording_id, seq AS line_no, text, x, gy AS y, CASE role WHEN 'user' THEN 'self' WHEN 'assistant' THEN 'other' ELSE 'system' END AS side FROM chat),
{spaced("apart", "given")},
talk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY y, x, slot) AS i FROM apart WHERE side <> 'system' AND NOT {TIME}),
turns AS (SELECT recording_id, i, side, x, y, 0 AS message_no FROM talk WHERE i = 1
  UNION ALL SELECT recording_id, i, side, CASE WHEN goes_on THEN first_x ELSE x END, y, CASE WHEN goes_on THEN message_no ELSE message_no + 1 END FROM (
    SELECT o.recording_id, o.i, o.side, o.x, o.y, t.x AS first_x, t.message_no, t.side = o.side AND o.y - t.y >= 0 AND o.y - t.y < 62 AND abs(o.x - t.x) < 60 AS goes_on
    FROM turns t JOIN talk o ON o.recording_id = t.recording_id AND o.i = t.i + 1)),
messages AS (SELECT recording_id, message_no, CASE side WHEN 'self' THEN 'M' ELSE 'T' END || string_agg(text, '' ORDER BY i) AS text FROM talk JOIN turns USING (recording_id, i, side) GROUP BY recording_id, message_no, side),
{unrepeated("fresh", "messages", "message_no", 9)}
SELECT recording_id, string_agg(CASE text[1] WHEN 'M' THEN '[我] ' ELSE '[对方] ' END || text[2:], chr(10) ORDER BY message_no) AS markdown FROM fresh GROUP BY 1""",
    "bubble_colours": """
SELECT p_partkey, CASE WHEN g - b > 40 THEN 'self' WHEN r > 200 AND g > 200 AND b > 200 THEN 'other' ELSE 'system' END AS side
FROM (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey * 13 % 256 AS b FROM part)""",
    "colour_channels": """
WITH p AS (SELECT p_partkey, p_partkey % 7 AS form, p_partkey * 7 % 256 AS r, p_partkey * 11 % 256 AS g, p_partkey * 13 % 256 AS b FROM part WHERE p_partkey IS NOT NULL),
c AS (SELECT p_partkey, CASE WHEN form <> 4 THEN r::DOUBLE END AS red, g::DOUBLE AS green, CASE WHEN form <> 3 THEN b::DOUBLE END AS blue FROM p)
SELECT *, CASE WHEN red IS NULL OR blue IS NULL THEN 'system' WHEN green - blue > 40 THEN 'self' WHEN least(red, green, blue) > 200 THEN 'other' ELSE 'system' END AS side FROM c""",
    "local_sources": """
WITH p AS (SELECT page_id, page_id % 8 AS k, url, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
s AS (SELECT *, CASE k WHEN 0 THEN path WHEN 1 THEN 'file://' || path WHEN 2 THEN 'content://media' || path WHEN 3 THEN '.' || path WHEN 4 THEN 'file://host' || path || '%20+a?q=1#f'
    WHEN 5 THEN 'file:' || path[2:] WHEN 6 THEN 'File://' || path ELSE url END AS source, CASE WHEN k < 2 OR k = 4 THEN regexp_replace(path, '[?#].*$', '') || CASE WHEN k = 4 AND NOT regexp_matches(path, '[?#]') THEN ' +a' ELSE '' END END AS image FROM p)
SELECT page_id, source, CASE WHEN k = 2 THEN source ELSE image END AS video, image FROM s""",
    "export_names": """SELECT event_id, 'export-' || strftime(ts, '%Y%m%dT%H%M%SZ') AS name FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL""",
    "timing_reconcile": """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(round(value * 100) AS BIGINT)) AS ms FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value >= 0 AND event_type IS NOT NULL GROUP BY 1, 2),
t AS (SELECT user_id, day, CAST(ms AS DOUBLE) AS accounted_ms, CAST(ms + user_id * 13 % 300 AS DOUBLE) AS total_ms FROM s)
SELECT user_id, day, total_ms, accounted_ms, total_ms - accounted_ms AS unclassified_ms, greatest(100, total_ms * 0.01) AS threshold_ms,
  abs(total_ms - accounted_ms) > greatest(100, total_ms * 0.01) AS should_warn FROM t""",
    "bundle_validation": f"""WITH {frames()},
f AS (SELECT recording_id, CAST(frame_idx AS INTEGER) AS frame_no, CASE WHEN recording_id % 10 = 7 AND frame_idx = 2 THEN 250.0 ELSE frame_idx * 250.0 END AS time_ms,
  frame_idx + 1 + CASE WHEN recording_id % 11 = 5 AND frame_idx > 1 THEN 1 ELSE 0 END AS file_no FROM frames),
v AS (SELECT recording_id, frame_no, file_no <> frame_no + 1 AS bad_file, time_ms <= lag(time_ms) OVER (PARTITION BY recording_id ORDER BY frame_no) AS bad_time FROM f)
SELECT recording_id, frame_no, CASE WHEN bad_file THEN 'sequence' ELSE 'time' END AS rule FROM v WHERE bad_file OR bad_time""",
    "capture_guards": """
WITH r AS (SELECT doc_id AS recording_id, CAST(n_chars * 7 + 0.5 AS DOUBLE) AS d FROM documents WHERE doc_id IS NOT NULL AND n_chars > 0),
wanted AS (SELECT recording_id, CAST(i // 5 AS INTEGER) AS idx, max(i // 5) OVER (PARTITION BY recording_id) AS last FROM r, unnest(range(0, greatest(1, CAST(floor(d / 250 + 0.5) AS BIGINT)), 5)) AS u(i)),
marked AS (SELECT recording_id, idx, CASE WHEN recording_id % 13 = 4 THEN 'count' WHEN recording_id % 17 = 6 AND idx = 1 THEN 'invalid' WHEN recording_id % 11 = 3 AND idx = 2 THEN 'time'
  WHEN recording_id % 7 = 2 AND idx >= 3 THEN 'size' END AS rule FROM wanted)
SELECT recording_id, arg_min(rule, idx) AS rule, min(idx) AS idx, count(*) AS n_faults FROM marked WHERE rule IS NOT NULL GROUP BY 1""",
    "first_differences": """
WITH copies AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN substr(text, 1, length(text) // 2)
  WHEN doc_id % 4 = 2 AND length(text) > 0 THEN substr(text, 1, length(text) // 3) || '~' || substr(text, length(text) // 3 + 2) END AS copy FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
octets AS (SELECT *, regexp_extract_all(hex(encode(text)), '..') AS a, regexp_extract_all(hex(encode(copy)), '..') AS b FROM copies),
found AS (SELECT *, list_position(list_transform(list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))]), lambda z: z[1] = z[2]), false) AS spot FROM octets)
SELECT doc_id, CAST(CASE WHEN copy IS NULL THEN NULL WHEN text = copy THEN -1 WHEN coalesce(spot, 0) > 0 THEN spot - 1 ELSE least(len(a), len(b)) END AS INTEGER) AS first_difference, md5(text) AS md5 FROM found""",
    "cached_bands": f"""WITH {frames()}, total AS (SELECT recording_id, count(*) AS frames FROM frames GROUP BY 1)
SELECT recording_id, band, hits, frames FROM (SELECT recording_id, CAST(floor(y / 20 + 0.5) AS BIGINT) AS band, count(DISTINCT frame_idx) AS hits FROM obs WHERE frame_idx % 3 <> 2 GROUP BY 1, 2)
  JOIN total USING (recording_id) WHERE frames > 1 AND hits / frames >= 0.8""",
    "term_rules": """
WITH rules(rule_no, term, allow, allow_label) AS (VALUES (0, 'worthless', NULL, NULL), (1, 'idiot', 'clown|loser', NULL), (2, 'tion the', 'and', NULL), (3, 'lich', 'ung|der', NULL), (4, 'ment de', NULL, '^src[0-4]$'),
  (5, 'ción', 'que|los', NULL), (6, 'the', '[aeiou]{4}', NULL), (7, 'the the', NULL, NULL), (8, '@', NULL, 'src1'), (9, 'idiot', NULL, NULL)),
docs AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(substr(text, 1, 2000), '[#*$%&]{3}')),
lines AS (SELECT doc_id AS recording_id, CAST(i - 1 AS INTEGER) AS line_no, source, p[i] AS text FROM docs, unnest(range(1, len(p) + 1)) AS u(i))
SELECT recording_id, line_no, rule_no, term FROM lines JOIN rules ON contains(text, term)
WHERE NOT coalesce(regexp_matches(text, allow), false) AND NOT coalesce(regexp_matches(source, allow_label), false)""",
    "retry_requests": f"""WITH RECURSIVE {RESOLVED}
SELECT recording_id AS run_id, 'f_' || lpad(CAST(recording_id AS VARCHAR), 4, '0') || '.jpg' AS asset, 'chat' AS mode, 'stitch' AS engine
FROM (SELECT recording_id, count(*) FILTER (warned) AS unresolved FROM resolved GROUP BY 1) JOIN (SELECT recording_id, count(nick) AS names FROM segments GROUP BY 1) USING (recording_id)
WHERE recording_id % 5 < 3 AND (names > 2 OR unresolved > 0)""",
    "normalized_lines": f"""WITH {LINES} SELECT recording_id, CAST(sum(length({normalized('text')})) AS BIGINT) AS n_chars, count(*) AS n_lines FROM lines GROUP BY 1""",
    "digests": """SELECT doc_id AS run_id, sha256(text) AS sha256, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS n_lines,
  length(text) AS n_chars FROM documents WHERE text IS NOT NULL""",
    "scroll_regions": f"""WITH {POSITIONS}, {regions(PREVIEW_SPREAD, 200)}
SELECT recording_id, CAST(CASE WHEN seen THEN top ELSE 0 END AS INTEGER) AS top, CAST(CASE WHEN seen THEN bottom ELSE 200 END AS INTEGER) AS bottom, high AS threshold,
  seen AND bottom - top >= 60 AS ok FROM found""",
    "pixel_shifts": f"""WITH {PIXEL_SHIFTS} SELECT * FROM shifts""",
    "key_frames": f"""WITH RECURSIVE {PIXEL_SHIFTS},
moved AS (SELECT recording_id, 0 AS k, 0 AS dy FROM shifts GROUP BY 1 UNION ALL SELECT recording_id, pair_idx, dy FROM shifts),
{key_frames("96", "160")}
SELECT recording_id, CAST(keep_no AS INTEGER) AS keep_no, CAST(k AS INTEGER) AS frame_idx, CAST(dropped AS INTEGER) AS dropped, CAST(count(*) FILTER (wide) OVER (PARTITION BY recording_id) AS INTEGER) AS too_far
FROM steps JOIN bounced USING (recording_id)""",
    # The scroll is known by construction: a frame is placed where it lies if that is below all before it.
    "stitched_images": f"""WITH {POSITIONS},
further AS (SELECT *, coalesce(position > max(position) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM placed)
SELECT recording_id, CAST(4 AS INTEGER) AS width, CAST(max(position) - 100 + 480 AS INTEGER) AS height, string_agg(CAST(position - 100 AS VARCHAR), ',' ORDER BY frame_idx) FILTER (new) AS offsets,
  CAST(count(*) FILTER (NOT new) AS INTEGER) AS skipped, CAST(0 AS INTEGER) AS n_unsure FROM further GROUP BY 1""",
    "stitch_plan": f"""WITH RECURSIVE {STITCH}""",
    "region_colours": f"""WITH {POSITIONS}, {pixels("range(0, 480)", "range(0, 4)")},
asked AS (SELECT recording_id, frame_idx, kind, x0, y0, x1, y1 FROM (
    SELECT recording_id, frame_idx, 'inside' AS kind, 1 AS x0, 40 + (11 * recording_id + 7 * frame_idx) % 300 AS y0, 3 AS x1, 43 + (11 * recording_id + 7 * frame_idx) % 300 + recording_id % 30 AS y1 FROM placed
    UNION ALL SELECT recording_id, frame_idx, 'edge', 0, 470 - recording_id % 50, 2, least(480, 560 - recording_id % 50) FROM placed)),
lit AS (SELECT a.*, p.r, p.g, p.b, p.r + p.g + p.b > 450 AS bright FROM asked a JOIN pixels p ON p.recording_id = a.recording_id AND p.frame_idx = a.frame_idx AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1),
chosen AS (SELECT *, count(*) FILTER (bright) OVER w AS n_bright, count(*) OVER w AS n FROM lit WINDOW w AS (PARTITION BY recording_id, frame_idx, kind)),
median AS (SELECT recording_id, frame_idx, kind, CAST(median(r) AS DOUBLE) AS red, CAST(median(g) AS DOUBLE) AS green, CAST(median(b) AS DOUBLE) AS blue, any_value(n_bright) AS n_bright, any_value(n) AS n
  FROM chosen WHERE bright OR n_bright < 20 GROUP BY 1, 2, 3)
SELECT recording_id, kind || '-' || frame_idx AS id, red, green, blue, CAST(n_bright AS INTEGER) AS bright_pixels, CAST(n AS INTEGER) AS decoded_pixels,
  CASE WHEN green - blue > 40 THEN 'me' WHEN red > 245 AND green > 245 AND blue > 245 THEN 'them' END AS side, NULL::VARCHAR AS error FROM median
UNION ALL SELECT recording_id, kind || '-' || frame_idx, NULL, NULL, NULL, 0, 0, NULL, error
FROM placed, (VALUES ('empty', 'E_RECT'), ('outside', 'E_RECT'), ('frame', 'E_FULL_FRAME_FORBIDDEN'), ('missing', 'E_FRAME')) AS e(kind, error)""",
}
