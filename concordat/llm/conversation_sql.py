"""SQL for the two operators on conversations, which says what they compute in other ways."""

from __future__ import annotations

_SHOWN = r"[^\x20\x09-\x0D]"
_WORD = _SHOWN + "+"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""


def _way(letters: str, cost: object, to: str, when: str = "true") -> str:
    """A cost and an audit that start with some letters and go on as from another state."""
    return f"CASE WHEN {when} THEN {{'c': {to}.c + {cost}, 'a': '{letters}' || {to}.a}} END"


def _least(*ways: str) -> str:
    return "list_min([x FOR x IN [" + ", ".join(ways) + "] IF x IS NOT NULL])"


def _step(state: int, kept: list[tuple[str, int]], onward: int) -> str:
    """The cheapest way on from a state through one row, without turns put in before it."""
    keeps = [_way("K", "late", f"f{to}", f"NOT gone AND kind = '{kind}'") for kind, to in kept]
    return _least(_way("D", 4, f"f{state}"), *keeps, _way("R", "3 + late", f"f{onward}", "NOT gone"))


def _opened(state: int, *after: int) -> str:
    """The same with empty turns before the row, which lead over the states after."""
    return _least(f"s{state}", *[_way("I" * (n + 1), 3 * (n + 1), f"s{to}") for n, to in enumerate(after)])


REPAIR = rf"""
        WITH RECURSIVE named AS (
            SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS cid, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations),
        damaged AS (
            SELECT conv_id, cid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM named),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS rn,
                   NOT regexp_matches(text, '{_SHOWN}') AS blank, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut FROM damaged),
        faulty AS (
            SELECT *, NOT blank AND row_number() OVER (PARTITION BY cid, role, text ORDER BY rn) > 1 AS again,
                   lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY rn) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
        symbols AS (SELECT cid, rn, left(role, 1) AS kind, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS late FROM faulty),
        counts AS (
            SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
                   count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
            FROM faulty GROUP BY cid),
        costs AS (
            SELECT cid, n + 1 AS i, {{'c': 0, 'a': ''}} AS f0, {{'c': 6, 'a': 'II'}} AS f1, {{'c': 3, 'a': 'I'}} AS f2, {{'c': 0, 'a': ''}} AS f3 FROM counts
            UNION ALL
            SELECT cid, i, {_opened(0, 2, 3)}, {_opened(1, 2, 3)}, {_opened(2, 3)}, {_opened(3, 2)}
            FROM (SELECT c.cid, rn AS i, {_step(0, [("s", 1), ("u", 2)], 2)} AS s0, {_step(1, [("u", 2)], 2)} AS s1, {_step(2, [("a", 3)], 3)} AS s2, {_step(3, [("u", 2)], 2)} AS s3
                  FROM costs c JOIN symbols y ON y.cid = c.cid AND y.rn = c.i - 1) t),
        solved AS (SELECT cid, f0.c AS cost, f0.a AS audit FROM costs WHERE i = 1),
        letters AS (SELECT cid, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS j FROM solved WHERE audit <> ''),
        edits AS (
            SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS rn, count(*) FILTER (WHERE letter <> 'D') OVER w AS o FROM letters
            WINDOW w AS (PARTITION BY cid ORDER BY j ROWS UNBOUNDED PRECEDING)),
        turns AS (
            SELECT e.cid, j, o, letter, p.role, CASE WHEN letter = 'I' THEN '' ELSE p.text END AS text,
                   max(CASE WHEN o = 1 AND letter = 'K' AND left(p.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.cid) AS system
            FROM edits e LEFT JOIN placed p ON p.cid = e.cid AND p.rn = e.rn WHERE letter <> 'D'),
        lines AS (
            SELECT cid, string_agg((CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS text
            FROM turns GROUP BY cid)
        SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(l.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, cid FROM named) n LEFT JOIN counts USING (cid) LEFT JOIN solved USING (cid) LEFT JOIN lines l USING (cid)"""

TRIE = rf"""
        WITH turns AS (
            SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
                   len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words
            FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS place FROM turns),
        sizes AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS takes FROM turns GROUP BY conv_id),
        whole AS (SELECT s.*, least(s.takes, coalesce(b.own, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
        rebuilt AS (
            SELECT w.conv_id, p.place AS depth, said, words FROM whole w JOIN placed p ON p.conv_id = w.base AND p.place <= w.taken
            UNION ALL
            SELECT w.conv_id, p.place - w.takes + w.taken, said, words FROM whole w JOIN placed p ON p.conv_id = w.conv_id AND p.place > w.takes),
        paths AS (
            SELECT conv_id, depth, words, string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM rebuilt
            UNION ALL SELECT conv_id, 0, 0, '' FROM whole),
        nodes AS (SELECT depth, prefix, max(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY depth, prefix),
        ups AS (SELECT depth, prefix, unnest(range(depth + 1)) AS up FROM nodes),
        above AS (SELECT depth, prefix, up, left(prefix, greatest(33 * up - 1, 0)) AS up_prefix FROM ups),
        parents AS (SELECT depth, prefix, up_prefix FROM above WHERE up = depth - 1),
        children AS (SELECT up_prefix AS prefix, count(*) AS n FROM parents GROUP BY up_prefix),
        below AS (
            SELECT a.up_prefix AS prefix, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
            FROM above a JOIN nodes n ON n.prefix = a.prefix LEFT JOIN children c ON c.prefix = a.prefix GROUP BY a.up_prefix),
        lengths AS (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM paths GROUP BY conv_id),
        ends AS (SELECT prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM lengths GROUP BY prefix)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM nodes n LEFT JOIN parents p ON p.prefix = n.prefix AND n.depth > 0 LEFT JOIN nodes u ON u.prefix = p.up_prefix
        LEFT JOIN children c ON c.prefix = n.prefix JOIN below b ON b.prefix = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix"""
