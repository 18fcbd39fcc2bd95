"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from loomwork.llm import chat_format, license_scan, quality_rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    rest = chat_format._control_rest()
    # RE2 has no lookahead, which the escape does not need either; its replacement writes a backslash as two.
    esc = lambda x: f"regexp_replace({x}, {_quoted('([<\\[])(\\\\*)(' + rest + ')')}, {_quoted('\\1\\2\\\\\\3')}, 'g')"
    frame = len(chat_format.START) + len("\n") + len(chat_format.END) + len("\n")
    role = f"replace(replace({esc('role')}, '%', '%25'), chr(10), '%0A')"
    return f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  sum({frame} + length({role}) + length({esc("text")})) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM k GROUP BY conv_id"""


def _license() -> str:
    lines = license_scan.COPYRIGHT_LINES.replace("(?imd)", "(?im)")

    def digest(x: str) -> str:
        kept = f"regexp_replace(coalesce({x}, ''), {_quoted(lines)}, '', 'g')"
        out = f"' ' || trim(regexp_replace(lower({kept}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for spelling, standard in license_scan.SPELLINGS:
            out = f"replace(replace({out}, ' {spelling} ', ' {standard} '), ' {spelling} ', ' {standard} ')"
        return f"sha256(trim({out}))"

    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in license_scan.KNOWN.items() for text in texts)
    more = ", ".join(f"({_quoted(d)}, {_quoted(name)})" for d, name in license_scan.KNOWN_DIGESTS.items())
    return f"""WITH known AS (SELECT digest, min(license_id) AS license_id FROM (
  SELECT {digest("text")} AS digest, license_id FROM (VALUES {rows}) AS t(license_id, text)
  UNION ALL SELECT * FROM (VALUES {more}) AS u(digest, license_id)) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license_id FROM (SELECT doc_id, {digest("text")} AS digest FROM documents) d LEFT JOIN known k ON k.digest = d.digest"""


def _rules() -> str:
    fails = []
    for rule in quality_rules.RULES:
        if rule.least is not None:
            fails.append(f"{rule.measure} < {rule.least}")
        if rule.most is not None:
            fails.append(f"{rule.measure} > {rule.most}")
    stops = ", ".join(map(_quoted, quality_rules.STOP_WORDS))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a),
tri AS (SELECT doc_id, i, x || ' ' || lead(x) OVER d || ' ' || lead(x, 2) OVER d AS g FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops, len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS bullets,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS ellipses FROM a LEFT JOIN cov ON cov.doc_id = a.doc_id),
r AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
  coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
  coalesce(bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_ratio FROM m),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(fails)}) AS kept FROM b"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, i: {bit}, xor(crc, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT), lambda crc, b: {byte}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def _repair() -> str:
    """The decoder's four states as columns, one recursion for each row; a state is (cost, initials, repaired lines)."""
    blanks, state = "[\\x20\\x09-\\x0D]", "STRUCT(c BIGINT, p VARCHAR, x VARCHAR)"
    then = lambda s, cost, edit, said="''", when="true": f"CASE WHEN {s} IS NOT NULL AND {when} THEN {{'c': {s}.c + {cost}, 'p': {s}.p || '{edit}', 'x': {s}.x || {said}}}::{state} END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    insert_u = least("u", *[then(s, 5, "I", user) for s in ("n", "s", "a")])
    insert_a = least("a", then("u0", 5, "I", assistant))
    said = "role || ':' || text || chr(10)"
    keep = lambda s, kind: then(s, "off", "K", said, f"NOT must AND kind = '{kind}'")
    turned = lambda s, role: then(s, "off + 1", "R", f"'{role}:' || text || chr(10)", "NOT must")
    before_u = ("n", "s", "a0")
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM dam),
flt AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  NOT regexp_matches(text, '[.!?]{blanks}*$') AS broken, role[1] AS kind, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM num),
r AS (SELECT conv_id, k, turn, role, text, kind, blank OR again AS must, CASE WHEN broken THEN 5 ELSE 0 END AS off, blank, again AND NOT blank AS dup,
  broken AND NOT blank AND NOT again AS cut, prev IS NOT NULL AND prev || kind NOT IN ('su', 'ua', 'au') AS bad FROM flt),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal, max(k) AS last FROM r GROUP BY conv_id),
steps(conv_id, k, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'p': '', 'x': ''}}::{state}, NULL::{state}, NULL::{state}, NULL::{state} FROM counts
  UNION ALL
  SELECT conv_id, k, {then("n", 2, "D")}, {least(then("s", 2, "D"), keep("n", "s"))},
    {least(then("u0", 2, "D"), *[keep(x, "u") for x in before_u], *[turned(x, "user") for x in before_u])},
    {least(then("a0", 2, "D"), keep("u0", "a"), turned("u0", "assistant"))}
  FROM (SELECT *, {insert_a} AS a0 FROM (SELECT *, {insert_u} AS u0 FROM
    (SELECT r.conv_id, r.k, r.role, r.text, r.kind, r.must, r.off, n, s, u, a FROM steps p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1)))),
fin AS (SELECT conv_id, {least("n", insert_a)} AS w FROM (SELECT p.conv_id, n, s, a, {insert_u} AS u0 FROM steps p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.last = p.k))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.p, '') AS audit, sha256(coalesce(left(w.x, length(w.x) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN fin f ON f.conv_id IS NOT DISTINCT FROM i.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _chat(), "op8_license_scan": _license(), "op9_quality_rules": _rules(), "op13_conversation_repair": _repair()}
