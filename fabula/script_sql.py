"""DuckDB SQL that gives the rows of the script queries, written from the operators' definitions."""

from __future__ import annotations

from . import lexicon as L

_T = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
SCRIPT = f"""turns AS (SELECT conv_id AS doc_id, turn::INT AS line_no, (conv_id + turn) % 10 AS k, {_T} AS t FROM conversations),
script AS (SELECT doc_id, line_no,
  CASE k WHEN 0 THEN '#g2' WHEN 1 THEN '#g?' WHEN 2 THEN '#g3' WHEN 4 THEN '#g?' WHEN 6 THEN '#g3' WHEN 7 THEN '#g1' WHEN 9 THEN '#g4' END AS gid,
  CASE k WHEN 0 THEN '— ' || t WHEN 1 THEN '«' || t || '», — сказав тато.' WHEN 2 THEN '— ' || t || ', — сказала Мама.' WHEN 3 THEN 'Тато повільно, ' || t || ', каже:' WHEN 4 THEN '— Мамо, ' || t || '?'
    WHEN 5 THEN '' WHEN 6 THEN '«' || t || '» — подумав хтось' WHEN 7 THEN 'думка: ' || t WHEN 8 THEN 'Глава ' || line_no ELSE '«' || t || '»' END AS body FROM turns)"""
_W = "(PARTITION BY doc_id ORDER BY line_no)"
_D = "regexp_matches(body, '^\\s*[-‒–—―«\"„“”’'']')"


def _with(query: str, *more: str) -> str:
    return f"WITH {', '.join((SCRIPT, *more))} {query}"


_NATION = """n AS (SELECT n_nationkey, n_regionkey::BIGINT AS doc_id, '#g' || (n_nationkey + 1) AS gid, upper(n_name[1]) || lower(n_name[2:]) AS a, n_name || 'o' AS b,
  CASE n_nationkey % 3 WHEN 0 THEN 'мати' WHEN 1 THEN 'дід' ELSE 'друг' END AS attr, n_nationkey % 3 AS r,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord FROM nation)"""
_KEY = "lower(translate({}, 'aceopxyiACEOPXYI', 'асеорхуіАСЕОРХУІ'))"
_LEVELS = """levels AS (SELECT (floor(user_id / 2)::BIGINT % 10)::VARCHAR AS stream_id, epoch_us(ts) // 18000 AS us, user_id % 2 = 0 AS loud, event_id FROM events)"""
_FORMS = "forms AS (SELECT * FROM (VALUES ('оповідач', '#g1'), ('мама', '#g2'), ('тато', '#g3'), ('думки', '#g4')) f(form, gid))"
_NAMES = "оповідач|думки|мама|тато"
# pieces of the rules' patterns, for a dialect without look-around; dashes come first in a class
_DASH, _QUOTE, _CLOSE, _END = "[-‒–—―]", "[«\"„“”''’]", "[»\"”''’]", "[.!?…\"”»]"
_WORD = r"\p{L}[\p{L}\d’''\-]+"
_NAME = r"[A-ZА-ЯЇІЄҐ][\p{L}\p{N}_’''\-]+"
_OWN = rf"regexp_matches(body, '(?s)^\s*[-‒–—―«\"„“”''’].*{_DASH}\s*{_NAME}')"
_TAIL = rf"nullif(regexp_extract(body, '(?s)^\s*{_QUOTE}.+{_CLOSE}\s*[, \t]*{_DASH}\s*(.+)$', 1), '')"
_PURE = rf"regexp_matches(body, '^\s*{_QUOTE}.+{_CLOSE}\s*[.!?…]*\s*$')"
_TOLD = "(gid IS NULL OR gid = '#g1')"


def _words(words: str) -> str:
    """A pattern of whole words."""
    return rf"(?i)(?:^|[^\p{{L}}])(?:{words.replace(r'\w', r'[\p{L}\p{N}_]').replace(chr(39), chr(39) * 2)})(?:[^\p{{L}}]|$)"


def _cues(words: str) -> str:
    """Whether one of the two lines before or after is narration with a word of these."""
    return f"cues AS (SELECT *, coalesce({_TOLD} AND regexp_matches(body, '{_words(words)}'), false) AS cue FROM script)"


_NEAR = "(coalesce(lag(cue) OVER w, false) OR coalesce(lead(cue) OVER w, false) OR coalesce(lag(cue, 2) OVER w, false) OR coalesce(lead(cue, 2) OVER w, false))"
#: Who is named in a line: each character once, and as often as named.
_NAMED = rf"words AS (SELECT doc_id, line_no AS place, unnest(regexp_extract_all(lower(body), '{_WORD}')) AS form FROM script), named AS (SELECT DISTINCT doc_id, place, gid FROM words JOIN forms USING (form))"
_EACH = r"words AS (SELECT doc_id, line_no AS place, unnest(regexp_extract_all(lower(body), '[A-Za-zА-Яа-яЇїІіЄєҐґ][\p{L}\p{N}_’'']+')) AS form FROM script), named AS (SELECT doc_id, place, gid FROM words JOIN forms USING (form))"
_MENTIONS = "mentions AS (SELECT s.doc_id, s.line_no, m.gid, sum(1 / (1 + abs(m.place - s.line_no))) AS weight FROM script s JOIN named m ON s.doc_id = m.doc_id AND m.place BETWEEN s.line_no - {0} AND s.line_no + {0} WHERE s.gid = '#g?' GROUP BY ALL)"
_EMBED = r"trim(regexp_replace(translate(body, chr(160) || '''ʼ′‘«»„“”', ' ’’’’\"\"\"\"\"'), '\s+', ' ', 'g'))".replace('\\"', '"')
_SPACES = "translate({}, chr(160) || chr(8239) || chr(8201) || chr(8199) || chr(8202) || chr(8203), '     ')"
_CLEAN = r"""b AS (SELECT *, regexp_replace(regexp_replace(body, '\s+([»”"])', '\1', 'g'), '([«"“])\s+', '\1', 'g') AS tight FROM script),
p AS (SELECT *, regexp_replace(tight, '\s+', ' ', 'g') AS said, regexp_replace(tight, '^[-,—–\s]+|[-,—–\s]+$', '', 'g') AS told FROM b WHERE NOT coalesce(gid <> '#g?' AND regexp_matches(trim(body), '^[-.,—–]?$'), false)),
q AS (SELECT doc_id, line_no, gid, CASE WHEN gid IS NULL OR gid = '#g?' THEN body
  WHEN gid = '#g1' THEN CASE WHEN told = '' OR regexp_matches(told, '[.!?…]$') THEN told ELSE told || '.' END
  WHEN said = '' OR regexp_matches(said, '[.!?…]$') THEN said WHEN regexp_matches(said, '[»”"]$') THEN regexp_replace(said, '([»”"])$', '.\1') ELSE said || '.' END AS body FROM p)"""
_CLEANED = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS line_no, gid, body FROM q WHERE gid IS NULL OR gid <> '#g1' OR body <> ''"
_TFIDF = """texts AS (SELECT p_partkey AS id, p_brand AS gid, lower(p_name || ' ' || p_type) AS text FROM part),
tokens AS (SELECT id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}')) AS token FROM texts),
tf AS (SELECT id, token, count(*) AS tf FROM tokens GROUP BY ALL),
idf AS (SELECT token, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token),
raw AS (SELECT id, token, tf * idf AS x FROM tf JOIN idf USING (token)),
w AS (SELECT id, token, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw)"""

#: How like "maria" a word is.
_LIKE = "CASE WHEN {0} = '' THEN 0.0 WHEN contains({0}, 'maria') OR contains('maria', {0}) THEN greatest(1 - levenshtein({0}, 'maria') / greatest(length({0}), 5), 0.8) ELSE 1 - levenshtein({0}, 'maria') / greatest(length({0}), 5) END"

SQL = {
    "reset_dialogs": _with(f"SELECT doc_id, line_no, CASE WHEN {_D} THEN '#g?' ELSE gid END AS gid, body FROM script"),
    "pretag": _with(f"SELECT doc_id, line_no, CASE WHEN trim(body) = '' THEN NULL WHEN {_D} THEN '#g?' ELSE '#g1' END AS gid, rtrim(body) AS body FROM script"),
    "demote_narrator_dialogs": _with(f"SELECT doc_id, line_no, CASE WHEN gid = '#g3' AND {_D} THEN '#g?' WHEN gid = '#g3' THEN '#g1' ELSE gid END AS gid FROM script"),
    "collapse_separators": _with(
        f"SELECT doc_id, (row_number() OVER {_W} - 1)::INT AS line_no, gid, CASE WHEN sep THEN '' ELSE body END AS body FROM kept",
        "cut AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 <> 0 THEN gid END AS gid, CASE WHEN line_no % 3 = 0 THEN '***' ELSE body END AS body FROM script)",
        r"seps AS (SELECT *, gid IS NULL AND (trim(body) = '' OR regexp_matches(body, '^\s*[-=*_#~·•.‒–—― ]{3,}\s*$')) AS sep FROM cut)",
        f"marked AS (SELECT *, coalesce(lag(sep) OVER {_W}, false) AS before FROM seps)",
        "kept AS (SELECT * FROM marked WHERE NOT (sep AND before))",
    ),
    "collapse_same_tags": _with(
        "SELECT doc_id, line_no, CASE WHEN same THEN NULL ELSE gid END AS gid, CASE WHEN same THEN ' ' || body ELSE body END AS body FROM f",
        "r AS (SELECT doc_id, line_no, CASE WHEN gid IN ('#g3', '#g4') THEN '#g1' ELSE gid END AS gid, regexp_replace(body, '^[—«] ?', '') AS body FROM script)",
        "m AS (SELECT *, CASE WHEN gid IS NOT NULL THEN gid WHEN trim(body) <> '' THEN '' END AS mark FROM r)",
        "v AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS force FROM m)",
        f"f AS (SELECT *, coalesce(gid = force AND gid <> '#g?' AND NOT {_D}, false) AS same FROM v)",
    ),
    "lead_and_spaces": _with(
        rf"""SELECT doc_id, line_no, regexp_replace(body, '^\s*{_DASH}\s*', '— ') AS lead, translate({_SPACES.format('body')}, '‐‑‒–—―«»„“”’ʼ′‘', '------""' || '""' || '"' || repeat('''', 4)) AS ascii, {_EMBED} AS embed, {_SPACES.format('body')} AS spaces FROM script""",
    ),
    "clean_dialog_punctuation": _with(_CLEANED, _CLEAN),
    "remove_block_markers": _with(_CLEANED, _CLEAN),  # boundaries leave no trace
    "mark_blocks": _with(
        f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, o) - 1)::INT AS line_no, gid, body FROM both_",
        f"d AS (SELECT *, gid IS NOT NULL AND gid <> '#g1' AND {_D} AS d FROM script)",
        f"s AS (SELECT *, d AND NOT coalesce(lag(d) OVER {_W}, false) AS st, lag(gid) OVER {_W} AS g0, coalesce(lag(body) OVER {_W}, '') AS b0 FROM d)",
        f"n AS (SELECT *, sum(st::INT) OVER {_W} AS block FROM s)",
        "marks AS (SELECT doc_id, line_no FROM n WHERE st AND block > 1 AND NOT ((g0 IS NULL AND trim(b0) = '') OR coalesce(g0 = '#g1', false)))",
        "both_ AS (SELECT doc_id, line_no, 1 AS o, gid, body FROM script UNION ALL SELECT doc_id, line_no, 0, '#g1', '[[DIALOG_BOUNDARY]]' FROM marks)",
    ),
    "demote_thoughts": _with(f"SELECT doc_id, line_no, CASE WHEN gid <> '#g1' AND regexp_matches({_TAIL}, '{_words(L.THOUGHT_VERBS)}') AND NOT regexp_matches(lower({_TAIL}), '{_NAMES}') THEN '#g?' ELSE gid END AS gid FROM script"),
    "thoughts_to_tag": _with(
        f"SELECT doc_id, line_no, CASE WHEN gid <> '#g1' AND (coalesce(regexp_matches({_TAIL}, '{_words(L.THOUGHT_VERBS + '|' + L.THOUGHT_PHRASES)}'), false) OR ({_TAIL} IS NULL AND {_PURE} AND {_NEAR})) THEN '#g4' ELSE gid END AS gid FROM cues WINDOW w AS {_W}",
        _cues(L.NEAR_THOUGHT),
    ),
    "demote_near_aphorism": _with(f"SELECT doc_id, line_no, CASE WHEN gid NOT IN ('#g1', '#g?') AND {_PURE} AND {_NEAR} THEN '#g?' ELSE gid END AS gid FROM cues WINDOW w AS {_W}", _cues(L.NEAR_APHORISM)),
    "rank_title_leadin": _with(
        f"SELECT doc_id, line_no, CASE WHEN gid = '#g?' AND {_D} AND NOT {_OWN} THEN coalesce(lag(found, 2) OVER w, lag(found) OVER w, gid) ELSE gid END AS gid FROM l WINDOW w AS {_W}",
        _FORMS,
        f"l AS (SELECT *, CASE WHEN {_TOLD} THEN (SELECT min(f.gid) FROM forms f WHERE contains(lower(body), f.form)) END AS found FROM script)",
    ),
    "first_person_leadin": _with(
        f"SELECT doc_id, line_no, CASE WHEN (free AND armed) OR (gid = '#g?' AND regexp_matches(body, '{_words(L.FIRST_PERSON_TAIL)}')) THEN '#g2' ELSE gid END AS gid FROM a",
        "r AS (SELECT doc_id, line_no, gid, regexp_replace(body, '^Тато повільно, (.*), каже:$', '\\1. Тоді я кажу:') AS body FROM script)",
        rf"l AS (SELECT *, regexp_matches(body, '(?i)(?:{L.FIRST_PERSON_LEADIN})\s*:\s*$') AND NOT {_D} AS lead, {_D} AND coalesce(gid, '#g?') = '#g?' AS free FROM r)",
        f"a AS (SELECT *, coalesce(lag(lead, 1) OVER w, false) OR (coalesce(lag(lead, 2) OVER w, false) AND NOT coalesce(lag(free, 1) OVER w, false)) OR (coalesce(lag(lead, 3) OVER w, false) AND NOT coalesce(lag(free, 1) OVER w, false) AND NOT coalesce(lag(free, 2) OVER w, false)) AS armed FROM l WINDOW w AS {_W})",
    ),
    "block_child_after_prologue": _with(
        "SELECT doc_id, line_no, CASE WHEN gid = '#g4' AND coalesce(max(ends AND begun) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN '#g?' ELSE gid END AS gid FROM b",
        "r AS (SELECT doc_id, line_no, gid, CASE WHEN line_no = 0 THEN 'Пролог' ELSE body END AS body FROM script)",
        r"e AS (SELECT *, regexp_matches(body, '(?i)^\s*пролог\.?\s*$') AS begins, regexp_matches(body, '(?i)^\s*(?:кінець прологу\.?|(?:розділ|частина|глава)\s+[\p{L}\p{N}_]+)\s*$') AS ends FROM r)",
        "b AS (SELECT *, coalesce(max(begins) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM e)",
    ),
    "first_person_to_child": _with(
        rf"SELECT doc_id, line_no, CASE WHEN gid = '#g?' AND {_D} AND regexp_matches(lower(body), '{_words(L.CHILD_WORDS)}') AND regexp_matches(' ' || lower(body), '[-\s«\"''—–]тато\s*[,!?:]') THEN '#g2' ELSE gid END AS gid FROM r",
        "r AS (SELECT doc_id, line_no, gid, regexp_replace(body, '^— Мамо, ', '— Тато, де мій? ') AS body FROM script)",
    ),
    "merge_around_attribution": _with(
        """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS line_no, CASE WHEN line_no % 2 = 1 THEN '#g1' ELSE '#g2' END AS gid,
CASE WHEN line_no % 4 = 1 AND line_no + 1 <= top THEN 'сказав він' WHEN line_no % 2 = 1 THEN '— сказав він,' WHEN line_no % 4 = 0 AND line_no + 2 <= top THEN '«' || line_no || '» ' || (line_no + 2) || '»' ELSE '«' || line_no || '»' END AS body
FROM m WHERE line_no % 4 <> 2""",
        "m AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS top FROM script)",
    ),
    "inline_sayer": _with(
        """SELECT doc_id, line_no, CASE WHEN NOT unknown OR name = '' THEN r.gid WHEN name = 'я' THEN '#g2'
  WHEN verb_gender IS NULL OR name_gender IS NULL OR verb_gender = name_gender THEN coalesce(f.gid, r.gid) ELSE r.gid END AS gid FROM g r LEFT JOIN forms f ON f.form = r.name AND f.gid <> '#g1'""",
        _FORMS,
        rf"""m AS (SELECT *, regexp_extract(body, '(?i){_DASH}[\s,—»\"“”''’]*({L.SAY_VERBS})\s+({_WORD}|я)(?:[^\p{{L}}]|$)', ['v', 'n']) AS vn, regexp_extract(body, '(?i){_DASH}[\s,—»\"“”''’]*({_WORD})\s+({L.SAY_VERBS})(?:[^\p{{L}}]|$)', ['n', 'v']) AS nv FROM script)""",
        f"n AS (SELECT *, gid = '#g?' AND {_D} AS unknown, lower(CASE WHEN vn['v'] <> '' THEN vn['v'] ELSE nv['v'] END) AS verb, lower(CASE WHEN vn['v'] <> '' THEN vn['n'] ELSE nv['n'] END) AS name FROM m)",
        f"g AS (SELECT *, CASE WHEN verb IN {L.SAY_FEMININE} THEN 'F' WHEN verb IN ('кажу', 'каже') THEN NULL WHEN verb IN {L.SAY_MASCULINE} THEN 'M' END AS verb_gender, CASE WHEN regexp_matches(name, '[аяеью]$') THEN 'F' WHEN regexp_matches(name, '[бвгґджзклмнпрстфхцчшщйо]$') THEN 'M' END AS name_gender FROM n)",
    ),
    "inline_verb_name": _with(
        "SELECT doc_id, line_no, CASE WHEN s.gid <> '#g1' THEN coalesce(f.gid, s.gid) ELSE s.gid END AS gid FROM n s LEFT JOIN forms f ON f.form = lower(regexp_extract(s.name, '^[^\\s]+')) AND f.gid <> '#g1'",
        _FORMS,
        rf"n AS (SELECT *, coalesce(nullif(regexp_extract(body, '(?i)(?:{_END}|,)\s*{_DASH}\s*(?:{L.VERBS_ANY})\s+({_WORD}(?:\s+{_WORD}){{0,2}})', 1), ''), regexp_extract(body, '(?i)(?:{_END}|,)\s*{_DASH}\s*({_WORD}(?:\s+{_WORD}){{0,2}})\s*,?\s*(?:{L.VERBS_ANY})(?:[^\p{{L}}]|$)', 1)) AS name FROM script)",
    ),
    "leadin_sayer": _with(
        "SELECT doc_id, line_no, CASE WHEN gid = '#g?' THEN coalesce(CASE WHEN f1 THEN l1 END, CASE WHEN f1 AND f2 THEN l2 END, gid) ELSE gid END AS gid FROM a",  # bodies start with a mark, no crowd is heard
        _FORMS,
        rf"n AS (SELECT *, regexp_extract(trim(body), '(?is)^\s*({_NAMES})\s+(?:.{{0,179}}?[^\p{{L}}])?({L.VERBS_ANY})(?:[^\p{{L}}]|$)', ['n', 'v']) AS m FROM script)",
        f"l AS (SELECT n.*, CASE WHEN n.gid IS NULL AND (regexp_matches(lower(m['v']), '^(?:{L.VERBS_N})$') OR regexp_matches(lower(m['v']), CASE f.gid WHEN '#g2' THEN '^(?:{L.VERBS_F})$' WHEN '#g3' THEN '^(?:{L.VERBS_M})$' ELSE '.' END)) THEN f.gid END AS lead FROM n LEFT JOIN forms f ON f.form = lower(m['n']) AND f.gid <> '#g1')",
        f"a AS (SELECT *, coalesce(lag(gid IS NULL) OVER w, false) AS f1, lag(lead) OVER w AS l1, coalesce(lag(gid IS NULL, 2) OVER w, false) AS f2, lag(lead, 2) OVER w AS l2 FROM l WINDOW w AS {_W})",
    ),
    "named_leadin": _with(
        f"SELECT doc_id, line_no, CASE WHEN speech AND NOT {_OWN} THEN coalesce(lag(lead) OVER w, CASE WHEN NOT coalesce(lag(speech) OVER w, false) THEN lag(lead, 2) OVER w END, gid) ELSE gid END AS gid FROM l WINDOW w AS {_W}",
        _FORMS,
        "b AS (SELECT *, regexp_extract(body, '(?s)^(.*):', 1) AS before FROM script)",
        f"l AS (SELECT b.*, coalesce(b.gid <> '#g1' AND {_D}, false) AS speech, CASE WHEN (b.gid IS NULL OR b.gid = '#g1') AND regexp_matches(right(before, 120), '(?i){L.COLON_VERBS}') THEN f.gid END AS lead FROM b LEFT JOIN forms f ON f.form = lower(regexp_extract_all(before, '(?i){_NAMES}')[-1]) AND f.gid <> '#g1')",
    ),
    "context_mentions": _with("SELECT doc_id, line_no, gid, round(weight, 6) AS weight FROM mentions", _FORMS, _NAMED, _MENTIONS.format(11)),
    "tag_counts": _with("SELECT doc_id, gid, count(*) AS n, CASE gid WHEN '#g?' THEN -1 ELSE substr(gid, 3)::INT END AS place FROM script WHERE gid IS NOT NULL GROUP BY doc_id, gid"),
    "scene_coverage": _with(
        """SELECT doc_id, scene, count(*) AS dialogs, count(*) FILTER (gid <> '#g?') AS assigned, count(*) FILTER (gid = '#g?') AS unknown,
  round(count(*) FILTER (gid <> '#g?') / count(*), 6) AS coverage, round(count(*) FILTER (gid = '#g?') / count(*), 6) AS unknown_share FROM d GROUP BY GROUPING SETS ((doc_id, scene), (doc_id))""",
        r"s AS (SELECT *, last_value(CASE WHEN regexp_matches(body, '(?i)^\s*(?:глава|розділ|частина)\s+(?:\d+|[IVXLCDM]+)\.?\s*$') THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM script)",
        f"d AS (SELECT doc_id, gid, coalesce(label, '(без сцени)') AS scene FROM s WHERE gid IS NOT NULL AND {_D})",
    ),
    "prf_averages": """WITH j AS (SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
l AS (SELECT gold AS label FROM j UNION SELECT pred FROM j),
t AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM l, j GROUP BY label),
p AS (SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t)
SELECT 'micro' AS kind, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM t
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM p WHERE precision + recall > 0""",
    "gold_marks": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '#g' || (o_orderkey % 7) WHEN 1 THEN '#g' || (o_orderkey % 5) END AS gold FROM orders",
    "legend_rows": f"WITH {_NATION} SELECT doc_id, gid, a || ' / ' || b || ' (' || CASE r WHEN 0 THEN 'F, мати' WHEN 1 THEN 'M, дід' ELSE 'головна героїня, друг' END || ')' AS name, ord::INT AS ord FROM n",
    "legend_characters": f"WITH {_NATION} SELECT doc_id, gid, a || '|' || b AS names, CASE r WHEN 2 THEN 'головна героїня|друг' ELSE attr END AS roles, CASE r WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender, r = 2 AS first_person FROM n",
    "legend_aliases": f"""WITH {_NATION}, k AS (SELECT doc_id, gid, n_nationkey, unnest([{_KEY.format('a')}, {_KEY.format('b')}, attr, CASE r WHEN 0 THEN 'мамо' WHEN 1 THEN 'діду' END, CASE r WHEN 2 THEN 'головна героїня' END]) AS alias FROM n)
SELECT doc_id, alias, arg_min(gid, n_nationkey) AS gid FROM k WHERE alias IS NOT NULL GROUP BY doc_id, alias""",
    "aliases": f"""WITH {_FORMS}, {_NATION}, k AS (SELECT doc_id, gid, n_nationkey, unnest([{_KEY.format('a')}, {_KEY.format('b')}, attr, CASE r WHEN 0 THEN 'мамо' WHEN 1 THEN 'діду' END, CASE r WHEN 2 THEN 'головна героїня' END]) AS alias FROM n),
c AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), a AS (SELECT doc_id, alias, arg_min(gid, n_nationkey) AS gid FROM k WHERE alias IS NOT NULL GROUP BY doc_id, alias)
SELECT doc_id, form AS alias, gid FROM c CROSS JOIN forms UNION ALL SELECT c.doc_id, alias, gid FROM c JOIN a ON a.doc_id = c.doc_id % 5""",
    "legend_fallback_aliases": f"""WITH {_NATION}, k AS (SELECT doc_id, gid, n_nationkey, unnest([lower(a), lower(b), attr, CASE r WHEN 0 THEN 'мамо' WHEN 1 THEN 'діду' END]) AS alias FROM n WHERE doc_id <> 0)
SELECT doc_id, alias, arg_min(gid, n_nationkey) AS gid FROM k WHERE alias IS NOT NULL GROUP BY doc_id, alias""",
    "legend_first_person": f"WITH {_NATION} SELECT doc_id, coalesce(arg_min(gid, n_nationkey) FILTER (r = 2), max(gid) FILTER (gid = '#g2')) AS first_person_gid FROM n GROUP BY doc_id",
    "legend_json": "SELECT n_regionkey::BIGINT AS doc_id, '#g' || n_nationkey AS gid, n_name AS name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS ord FROM nation",
    "legend_records": """SELECT n_regionkey::BIGINT AS doc_id, '#g' || n_nationkey AS gid, n_name AS names,
  CASE n_regionkey % 5 WHEN 0 THEN lower(n_name) WHEN 3 THEN CASE WHEN n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) THEN 'наратив|оповідач|оповідачка' ELSE '' END WHEN 4 THEN 'f|' || lower(left(n_name, 3)) ELSE '' END AS aliases,
  CASE WHEN n_regionkey % 5 = 0 AND n_nationkey % 2 = 0 OR n_regionkey % 5 = 4 THEN 'F' END AS gender FROM nation""",
    "legend_in_text": f"WITH {_NATION} SELECT doc_id, gid, a || ' / ' || b || ' (' || CASE r WHEN 0 THEN 'F, мати' WHEN 1 THEN 'M, дід' ELSE 'головна героїня, друг' END || ')' AS name FROM n",
    "morph_aliases": f"""WITH {_NATION}, k AS (SELECT doc_id, gid, unnest(CASE r WHEN 0 THEN ['мати'] WHEN 1 THEN ['дід', 'діду', 'дідом', 'діде', 'діда', 'дідоню', 'дідусю', 'дідусь', 'дідуся', 'дідусем'] ELSE ['друг'] END) AS alias FROM n)
SELECT doc_id, alias, string_agg(DISTINCT gid, '|' ORDER BY gid) AS gids FROM k GROUP BY doc_id, alias""",
    "name_forms": f"""WITH {_NATION}, k AS (SELECT doc_id, gid, n_nationkey, lower(unnest([a, b])) AS name FROM n),
f AS (SELECT doc_id, gid, n_nationkey, name || unnest(['', 'а', 'у', 'ом', 'ові', 'е', 'ю', 'і']) AS form FROM k)
SELECT doc_id, form, arg_max(gid, n_nationkey) AS gid FROM f GROUP BY doc_id, form""",
    "fuzzy_names": """WITH n AS (SELECT DISTINCT c_name AS name FROM customer)
SELECT a.name, b.name AS other, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 1""",
    "fuzzy_words": r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) AS name FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) AS form FROM conversations)
SELECT name, form, levenshtein(name, form)::INT AS distance FROM a JOIN b ON regexp_matches(name, '^[a-z]+$') AND regexp_matches(form, '^[a-z]+$') AND abs(length(name) - length(form)) <= 2 AND levenshtein(name, form) <= 2""",
    "nearest_speaker": _with(
        "SELECT a.doc_id, a.line_no, a.gender, CASE WHEN a.line_no - k.line_no <= 6 THEN k.gid END AS gid, CASE WHEN a.line_no - k.line_no <= 6 THEN k.line_no END AS at FROM asked a ASOF LEFT JOIN known k ON a.doc_id = k.doc_id AND a.gender = k.gender AND a.line_no > k.line_no",
        "asked AS (SELECT doc_id, line_no, unnest(['F', 'M']) AS gender FROM script WHERE gid = '#g?')",
        "known AS (SELECT doc_id, line_no, CASE gid WHEN '#g2' THEN 'F' ELSE 'M' END AS gender, gid FROM script WHERE gid IN ('#g2', '#g3'))",
    ),
    "lines_in_scenes": _with(
        "SELECT script.doc_id, line_no, gid, label FROM script JOIN spans ON script.doc_id = spans.doc_id AND line_no BETWEEN start_line AND end_line",
        r"s AS (SELECT *, last_value(CASE WHEN regexp_matches(body, '(?i)^\s*(?:глава|розділ|частина)\s+(?:\d+|[IVXLCDM]+)\.?\s*$') THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM script)",
        "spans AS (SELECT doc_id, label, min(line_no) AS start_line, max(line_no) AS end_line FROM s WHERE label IS NOT NULL GROUP BY doc_id, label)",
    ),
    "name_mentions": r"""WITH f AS (SELECT conv_id AS doc_id, turn, lower(regexp_extract(text, '[A-Za-z]{5,}')) AS alias FROM conversations),
n AS (SELECT doc_id, alias, '#g' || min(turn) AS gid FROM f WHERE alias <> '' GROUP BY ALL),
w AS (SELECT conv_id AS doc_id, turn AS line_no, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS alias FROM conversations)
SELECT doc_id, line_no, alias, gid, count(*) AS n FROM w JOIN n USING (doc_id, alias) GROUP BY ALL""",
    "utterances": f"""WITH {_LEVELS}, l AS (SELECT *, us - lag(us) OVER (PARTITION BY stream_id ORDER BY us, event_id) >= 1000000 AS gap FROM levels WHERE loud),
g AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY stream_id ORDER BY us, event_id) AS spell FROM l)
SELECT stream_id, min(us) AS start_us, max(us) AS stop_us, count(*) AS n FROM g GROUP BY stream_id, spell HAVING max(us) - min(us) >= 500000""",
    "cut_utterances": f"""WITH RECURSIVE {_LEVELS}, l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY us, event_id) AS i FROM levels WHERE loud),
r AS (SELECT stream_id, i, us, us AS start, 1 AS spell FROM l WHERE i = 1
  UNION ALL SELECT l.stream_id, l.i, l.us, CASE WHEN l.us - r.us >= 1000000 OR r.us - r.start > 10000000 THEN l.us ELSE r.start END, r.spell + (l.us - r.us >= 1000000 OR r.us - r.start > 10000000)::INT FROM r JOIN l ON l.stream_id = r.stream_id AND l.i = r.i + 1)
SELECT stream_id, min(us) AS start_us, max(us) AS stop_us, count(*) AS n FROM r GROUP BY stream_id, spell HAVING max(us) - min(us) >= 500000""",
    "cooled_commands": f"""WITH RECURSIVE {_LEVELS}, l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY us, event_id) AS i FROM levels WHERE loud),
r AS (SELECT stream_id, i, us, event_id, us AS last, true AS kept FROM l WHERE i = 1
  UNION ALL SELECT l.stream_id, l.i, l.us, l.event_id, CASE WHEN l.us - r.last >= 1000000 THEN l.us ELSE r.last END, l.us - r.last >= 1000000 FROM r JOIN l ON l.stream_id = r.stream_id AND l.i = r.i + 1)
SELECT stream_id, us, event_id FROM r WHERE kept""",
    "while_running": f"""WITH {_LEVELS}, c AS (SELECT stream_id, us, max(event_id % 20 = 0) AS paused FROM levels WHERE event_id % 10 = 0 GROUP BY ALL),
x AS (SELECT l.stream_id, l.event_id, c.paused FROM (SELECT * FROM levels WHERE event_id % 10 <> 0) l ASOF LEFT JOIN c ON l.stream_id = c.stream_id AND l.us >= c.us)
SELECT stream_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM x WHERE NOT coalesce(paused, false) GROUP BY stream_id""",
    "last_entries": "SELECT user_id AS key, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "best_transcript": """WITH r AS (SELECT l_orderkey AS id, l_linenumber::VARCHAR AS model, max(round(1 - l_discount * 8, 2)) AS confidence, max(repeat('x', (l_quantity % 9 + 1)::INT)) AS text FROM lineitem GROUP BY ALL)
SELECT id, text FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence > 0.6 DESC, CASE WHEN confidence > 0.6 THEN length(text) * confidence ELSE confidence END DESC, model) = 1""",
    "routed_commands": rf"""WITH t AS (SELECT event_id, ['maria ', 'Marja ', 'petra ', '', 'maria, ', 'hey mariah! '][(event_id // 6) % 6 + 1] || CASE event_id % 6 WHEN 0 THEN 'відкрий блокнот' WHEN 1 THEN 'який зараз час' WHEN 2 THEN 'яка сьогодні дата' WHEN 3 THEN 'порахуй 2 + 3' WHEN 4 THEN event_type ELSE props END AS text FROM events),
w AS (SELECT *, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS words, list_transform(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: {_LIKE.format('w')}) AS likes,
  list_transform(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: length(w) >= 3) AS long FROM t),
k AS (SELECT *, list_filter(words, lambda w: {_LIKE.format("regexp_replace(lower(w), '^[,.!?;:]+|[,.!?;:]+$', '', 'g')")} < 0.75) AS kept FROM w),
c AS (SELECT event_id, text, length(trim(text)) >= 2 AND len(list_filter(list_zip(likes, long), lambda z: z[1] = 1 OR (z[2] AND z[1] >= 0.75))) > 0 AS called,
  CASE WHEN lower(text) LIKE 'maria %' OR lower(text) LIKE 'maria,%' THEN trim(substr(text, 7)) WHEN len(kept) > 0 THEN array_to_string(kept, ' ') WHEN len(words) > 1 THEN array_to_string(words[2:], ' ') ELSE text END AS command FROM k)
SELECT event_id, called, command, CASE WHEN len(regexp_split_to_array(trim(command), '\s+')) > 6 THEN 'planner' WHEN length(trim(command)) < 3 THEN 'ignored' WHEN event_id % 11 = 0 THEN 'cache'
  WHEN regexp_matches(lower(command), 'відкрий\s+(?:блокнот|notepad)') THEN 'open_program' WHEN regexp_matches(lower(command), 'порахуй\s+\d+\s*[-+*−]\s*\d+') THEN 'calculate'
  WHEN regexp_matches(lower(command), 'який\s+(?:зараз\s+)?час') THEN 'get_time' WHEN regexp_matches(lower(command), 'яка\s+(?:сьогодні\s+)?дата') THEN 'get_date' ELSE 'model' END AS route FROM c""",
    "answers_json": "SELECT event_id, md5(props) AS json_md5 FROM events",
    "tagged_sounds": """WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' Надворі падає дощ. Далі.' WHEN 1 THEN ' Пролунав крик і прогримів вибух!' ELSE '' END AS t FROM documents),
h AS (SELECT doc_id, len(regexp_extract_all(t, '(?i)зашумів дощ|падає дощ|шум дощу|пішов дощ|дощ трохи посипався')) AS rain, len(regexp_extract_all(t, '(?i)прогримів вибух|голосно бахнуло|постріл пролунав|грім вдарив')) AS v FROM t)
SELECT doc_id, rain + v AS n_tags, (1 + rain)::INT AS rain, (1 + v)::INT AS v FROM h""",
    "unknown_sound_tags": r"""WITH t AS (SELECT unnest(string_split('text' || chr(10) || '#s' || (o_orderkey % 4) || chr(10) || '#rain' || chr(10) || '#p2', chr(10))) AS tag FROM orders)
SELECT tag, count(*) AS n FROM t WHERE regexp_matches(tag, '^#[A-Za-z]\w*$') AND NOT regexp_matches(tag, '^#g') AND tag NOT IN ('#rain', '#p2') GROUP BY tag""",
    "rewritten_documents": r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
t AS (SELECT doc_id, replace(replace(coalesce(array_to_string(s, ' '), ''), 'th', 'TH'), 'an', 'AN') AS t FROM s) SELECT doc_id, length(t) AS n_chars, md5(t) AS h FROM t""",
    "tfidf": f"WITH {_TFIDF} SELECT id, token, round(w, 6) AS w FROM w",
    "mean_vectors": f"WITH {_TFIDF}, m AS (SELECT gid, token, sum(w) AS s FROM w JOIN texts USING (id) GROUP BY ALL) SELECT gid, token, round(s / sqrt(sum(s * s) OVER (PARTITION BY gid)), 6) AS w FROM m",
    "best_by_text": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id, b.label, sum(a.x * b.x) AS score FROM e a JOIN e b USING (k) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
t AS (SELECT id, label, max(score) AS score FROM s GROUP BY ALL)
SELECT id, CASE WHEN max(score) >= 0.35 THEN '#g' || arg_max(label, score) ELSE '#g?' END AS decision, round(max(score), 5) AS score FROM t GROUP BY id""",
    "speaker_queries": _with(
        """SELECT s.doc_id, s.line_no, md5(concat_ws(' ', nullif(s.e, ''), string_agg(o.e, ' ' ORDER BY o.line_no))) AS h
FROM q s LEFT JOIN q o ON s.doc_id = o.doc_id AND o.line_no BETWEEN s.line_no - 11 AND s.line_no + 11 AND o.line_no <> s.line_no AND o.gid <> '#g?' AND o.e <> '' WHERE s.gid = '#g?' GROUP BY s.doc_id, s.line_no, s.e""",
        f"q AS (SELECT doc_id, line_no, gid, {_EMBED} AS e FROM script WHERE gid IS NOT NULL)",
    ),
    "speaker_mentions": _with("SELECT doc_id, line_no, gid, round(weight, 6) AS weight FROM mentions", _FORMS, _EACH, _MENTIONS.format(11)),
    "speaker_candidates": _with(
        """SELECT doc_id, line_no, gid FROM g WHERE ok OR NOT any_ok""",
        _FORMS, _EACH, _MENTIONS.format(11),
        f"h AS (SELECT doc_id, line_no, gid, body, CASE WHEN regexp_matches(body, '{_words(L.HINT_M)}') THEN 'M' WHEN regexp_matches(body, '{_words(L.HINT_F)}') THEN 'F' WHEN contains(lower(body), 'чоловічий голос') THEN 'M' WHEN contains(lower(body), 'жіночий голос') THEN 'F' END AS h FROM script)",
        f"lines AS (SELECT *, coalesce(lag(h) OVER {_W}, h) AS hint FROM h)",
        "every AS (SELECT s.doc_id, s.line_no, f.gid, m.gid IS NOT NULL AS near, hint FROM lines s CROSS JOIN forms f LEFT JOIN mentions m ON m.doc_id = s.doc_id AND m.line_no = s.line_no AND m.gid = f.gid WHERE s.gid = '#g?')",
        "pool AS (SELECT *, max(near) OVER (PARTITION BY doc_id, line_no) AS some_near FROM every)",
        "kept AS (SELECT *, CASE gid WHEN '#g2' THEN 'F' WHEN '#g3' THEN 'M' END AS gender FROM pool WHERE near OR NOT some_near)",
        "typed AS (SELECT *, hint IS NULL OR gender IS NULL OR gender = hint AS ok FROM kept)",
        "g AS (SELECT *, max(ok) OVER (PARTITION BY doc_id, line_no) AS any_ok FROM typed)",
    ),
    "characters": f"""WITH {_FORMS}, {_NATION}, c AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)
SELECT doc_id, gid, CASE gid WHEN '#g2' THEN 'F' WHEN '#g3' THEN 'M' END AS gender, upper(left(form, 1)) || substr(form, 2) AS names FROM c CROSS JOIN forms
UNION ALL SELECT c.doc_id, gid, CASE r WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender, a || '/' || b AS names FROM c JOIN n ON n.doc_id = c.doc_id % 5""",
    "scene_spans": _with(
        "SELECT doc_id, label, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line FROM s WHERE label IS NOT NULL GROUP BY doc_id, label",
        r"s AS (SELECT *, last_value(CASE WHEN regexp_matches(body, '(?i)^\s*(?:глава|розділ|частина)\s+(?:\d+|[IVXLCDM]+)\.?\s*$') THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM script)",
    ),
    "sentence_chunks": r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, s, 1 AS i, 0 AS chunk_no, length(s[1]) AS n FROM p WHERE len(s) > 0
  UNION ALL SELECT doc_id, s, i + 1, chunk_no + (n + 1 + length(s[i + 1]) > 500)::INT, CASE WHEN n + 1 + length(s[i + 1]) > 500 THEN length(s[i + 1]) ELSE n + 1 + length(s[i + 1]) END FROM r WHERE i < len(s))
SELECT doc_id, chunk_no, max(n)::INT AS n_chars FROM r GROUP BY doc_id, chunk_no""",
    "sounds": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+([.,?!])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t, text FROM documents)
SELECT doc_id, 0::INT AS n_tags, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(t) + 1 END::INT AS n_chars FROM t""",
    "speaker_neighbours": _with(
        f"SELECT doc_id, line_no, b AS before, CASE WHEN lead(gid) OVER {_W} IS NOT NULL THEN lead(b) OVER {_W} END AS after FROM p",
        "p AS (SELECT *, last_value(CASE WHEN gid NOT IN ('#g?', '#g1') THEN gid END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM script)",
    ),
    "first_texts": _with(
        "SELECT doc_id, gid, count(DISTINCT e) AS n, sum(DISTINCT ('0x' || left(md5(e), 8))::BIGINT)::BIGINT AS sum FROM (SELECT doc_id, gid, e FROM said UNION ALL SELECT DISTINCT c.conv_id, f.gid, upper(left(f.form, 1)) || substr(f.form, 2) FROM conversations c CROSS JOIN forms f) GROUP BY ALL",
        _FORMS,
        f"r AS (SELECT *, {_EMBED} AS e, row_number() OVER (PARTITION BY doc_id, gid ORDER BY line_no) AS i FROM script WHERE gid NOT IN ('#g?', '#g1'))",
        "said AS (SELECT * FROM r WHERE i <= 6 AND e <> '')",
    ),
}
