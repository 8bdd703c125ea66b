"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from feedspark.llm import chat, mixing, quality, repair, spelling

SPACE_SQL = r"[\x20\x09-\x0D]+"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_ctes(source: str = "documents") -> str:
    tests = []
    for rule in quality.RULES:
        sides = ([f"{rule.measure} < {rule.low}"] if rule.low is not None else []) + (
            [f"{rule.measure} > {rule.high}"] if rule.high is not None else []
        )
        tests += [f"CASE WHEN {side} THEN '{rule.measure}' END" for side in sides]
    return rf"""
qd AS (SELECT row_number() OVER () AS k, * FROM {source}),
qw AS (SELECT k, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE_SQL}'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
       FROM qd),
qwin AS (SELECT k, i, list_slice(ws, i, i + {quality.WINDOW - 1}) AS win
         FROM (SELECT k, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM qw)),
qdup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM qwin) WHERE n > 1),
qrep AS (SELECT k, count(DISTINCT p) AS n FROM
           (SELECT k, unnest(range(i, i + {quality.WINDOW})) AS p FROM qdup) GROUP BY k),
qm AS (SELECT k, doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda w: lower(w) IN ({quoted(quality.STOP_WORDS)})))::BIGINT AS n_stop_words,
         coalesce(qrep.n, 0)::BIGINT AS n_repeat_words
       FROM qw LEFT JOIN qrep USING (k)),
qr AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_line_ratio,
         CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END AS capital_ratio,
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed
       FROM qm),
qj AS (SELECT *, concat_ws(',', {", ".join(tests)}) AS broken_rules FROM qr)"""


def quality_sql() -> str:
    return f"""WITH {quality_ctes()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM qj"""


def jaccard_ctes(source: str = "documents") -> str:
    """``jc``: per row of ``source`` (``doc_id``, ``text``) its shingle count and component id."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
jd AS (SELECT row_number() OVER () AS k, doc_id,
         list_filter(string_split_regex({lower}, '{SPACE_SQL}'), lambda x: x <> '') AS ws FROM {source}),
js AS (SELECT k, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM jd),
jp AS (SELECT k, doc_id, len(sh) AS n, unnest(sh) AS s FROM js),
jo AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS na, b.n AS nb, count(*) AS o
       FROM jp a JOIN jp b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k, a.doc_id, b.doc_id, a.n, b.n),
je AS (SELECT DISTINCT u, v FROM jo WHERE 100 * o >= 75 * (na + nb - o)),
jr AS (SELECT u AS x, u AS y FROM je UNION SELECT r.x, e.v FROM jr r JOIN je e ON r.y = e.u),
jm AS (SELECT x, min(y) AS component_id FROM jr GROUP BY x),
jc AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(coalesce(component_id, doc_id), doc_id) AS component_id
       FROM js LEFT JOIN jm ON jm.x = js.doc_id)"""


def jaccard_sql() -> str:
    return f"WITH RECURSIVE {jaccard_ctes()}\nSELECT * FROM jc"


def chat_sql() -> str:
    """Sizes follow from the template: every example holds all turns up to its own."""
    q = lambda t: "'" + t + "'"
    body = "replace(text, '\\', '\\\\')"
    for control in chat.CONTROLS:
        body = f"replace({body}, {q(control)}, {q(control[0] + chr(92) + control[1:])})"
    frame = len(chat.OPEN + chat.MIDDLE + chat.CLOSE)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
s AS (SELECT *, length(role) + length({body}) + {frame} AS size,
        sum(length(role) + length({body}) + {frame}) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM s GROUP BY conv_id"""


def mixing_sql() -> str:
    """The same draws and phases, walked row by row; the level by rounds until it stays."""
    listed = ", ".join(str(w) for w in mixing.WEIGHTS)
    cap = f"size * {mixing.MOST_EPOCHS}"
    return rf"""WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE_SQL}'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:{mixing.DIGITS}])::BIGINT AS draw
  FROM documents),
s AS (SELECT *, list_value({listed})[(rank - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight
      FROM (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
levels AS (
  SELECT (SELECT sum(size) FROM s) * {mixing.SHARE} / (SELECT sum(weight) FROM s) AS found
  UNION
  SELECT ((SELECT sum(size) FROM s) * {mixing.SHARE} - coalesce(sum(size) FILTER ({cap} < weight * found), 0) * {mixing.MOST_EPOCHS})
    / sum(weight) FILTER (NOT {cap} < weight * found)
  FROM levels, s GROUP BY found),
aims AS (SELECT *, least({cap}, weight * (SELECT max(found) FROM levels)) AS target FROM s),
plan AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END::BIGINT AS whole FROM aims),
units AS (SELECT rank, draw, sum(d.size)::BIGINT AS unit, max(d.size) AS longest,
            row_number() OVER (PARTITION BY rank ORDER BY draw) AS k
          FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size > 0 GROUP BY rank, draw),
walk AS (
  SELECT rank, target, 0::BIGINT AS k, NULL::BIGINT AS draw, false AS taken, floor(target)::BIGINT - whole * size AS room,
    floor(target)::BIGINT - whole * size AS most, floor(target)::BIGINT - whole * size > target * {mixing.NEAR} AS live
  FROM plan
  UNION ALL
  SELECT w.rank, w.target, u.k, u.draw, w.live AND longest <= most AND unit <= room,
    CASE WHEN w.live AND longest <= most AND unit <= room THEN room - unit ELSE room END,
    CASE WHEN longest <= most AND unit > room THEN room ELSE most END,
    w.live AND NOT (longest <= most AND unit > room AND room <= w.target * {mixing.NEAR})
  FROM walk w JOIN units u ON u.rank = w.rank AND u.k = w.k + 1)
SELECT d.doc_id, d.size, p.size AS source_size, p.target,
  whole + coalesce(taken, false)::BIGINT AS copies, (whole + coalesce(taken, false)::BIGINT) * d.size AS taken
FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN walk w ON w.rank = p.rank AND w.draw = d.draw AND d.size > 0"""


def crc32_ctes() -> str:
    """``crc``: the table of the checksum with the polynomial that zip files use."""
    return """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries)"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text of code points below U+0100; ``entries`` is that of ``crc``."""
    octets = f"""flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
          ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}),
          lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


def spelling_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    least = spelling.LEAST_CHARS
    return rf"""WITH RECURSIVE {crc32_ctes()},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS name, unnest(regexp_extract_all({lower}, '{spelling.LETTERS}')) AS run FROM documents),
tokens AS (SELECT name, run, count(*) AS k FROM runs WHERE length(run) >= {least} GROUP BY name, run),
hashed AS (SELECT run, k, {crc32_sql("name || ':' || run")} AS h FROM tokens, crc),
words AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0
            THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, k FROM hashed),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= {least}
          GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
holes AS (SELECT word, n, i, word[1:i - 1] AS front, word[i + 1:] AS back
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.front = b.front AND a.back = b.back
    WHERE a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON b.word = a.front || a.back
  UNION
  SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON b.word = a.front || a.back),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM pairs),
formed AS (SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
             CASE WHEN r.near_n >= {spelling.RATIO} * v.n THEN r.near END AS form,
             CASE WHEN r.near_n >= {spelling.RATIO} * v.n THEN r.near_n END AS form_n
           FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
chain AS (SELECT word, word AS root FROM formed UNION ALL
          SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word"""


def repair_sql() -> str:
    """The cheapest repair by steps over the rows; weights compare as padded cost and audit."""
    spelled = lambda c: f"coalesce({c}::VARCHAR, ' ')"
    nxt = "CASE WHEN {0} = 'u' THEN 'a' ELSE 'u' END"
    return rf"""WITH RECURSIVE {crc32_ctes()},
given AS (SELECT conv_id, turn, {spelled("role")} AS role, {spelled("text")} AS text,
            {crc32_sql(f"{spelled('conv_id')} || ':' || {spelled('turn')}")} % {repair.DAMAGE} AS kind FROM conversations, crc),
harmed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM given, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS pos FROM harmed),
marked AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS ini_before FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
sums AS (SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pos > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(pos) AS rows
         FROM convs c LEFT JOIN marked m ON c.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY c.conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS used, '' AS state, printf('%012d', 0) AS weight FROM convs
  UNION ALL
  SELECT conv_id, used + 1, state_after, min(printf('%012d', cost) || audit)
  FROM (SELECT w.conv_id, used, weight[1:12]::BIGINT + 3 * k + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
            + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
          weight[13:] || repeat('I', k) || edit AS audit,
          CASE edit WHEN 'D' THEN st WHEN 'K' THEN ini ELSE {nxt.format("st")} END AS state_after
        FROM (SELECT *, CASE k WHEN 0 THEN state WHEN 1 THEN {nxt.format("state")}
                ELSE CASE WHEN state = 'u' THEN 'u' ELSE 'a' END END AS st
              FROM walk, (SELECT unnest([0, 1, 2]) AS k)) w
          JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.pos = w.used + 1,
          (SELECT unnest(['D', 'K', 'R']) AS edit)
        WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate')
          AND (edit = 'R' OR st || ini IN ('su', 'ua', 'au') OR st = '' AND ini IN ('s', 'u'))))
  GROUP BY conv_id, used + 1, state_after),
ends AS (SELECT w.conv_id, min(printf('%012d', weight[1:12]::BIGINT + 3 * k) || weight[13:] || repeat('I', k)) AS weight
         FROM (SELECT *, CASE state WHEN 'u' THEN 1 WHEN 's' THEN 2 ELSE 0 END AS k FROM walk) w
           JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.rows = w.used GROUP BY w.conv_id),
steps AS (SELECT conv_id, weight[13:] AS audit, unnest(range(1, length(weight) - 11)) AS j FROM ends),
edits AS (SELECT conv_id, j, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS pos FROM steps),
live AS (SELECT e.conv_id, j, edit, m.role, coalesce(m.text, '') AS text,
           row_number() OVER (PARTITION BY e.conv_id ORDER BY j) AS place,
           first_value(edit = 'K' AND ini = 's') OVER (PARTITION BY e.conv_id ORDER BY j) AS led
         FROM edits e LEFT JOIN marked m ON edit <> 'I' AND e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.pos = m.pos WHERE edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole FROM live GROUP BY conv_id)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, weight[1:12]::BIGINT AS cost, weight[13:] AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM sums s JOIN ends e ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN lines l ON s.conv_id IS NOT DISTINCT FROM l.conv_id"""
