"""SQL that gives the rows of a query by other means, where it takes more than a few lines."""

from __future__ import annotations

#: Strings of 400 bytes by their digests: hex digits of a text, in pieces of 500 starts each.
REPEATED_STRINGS = r"""
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    pieces AS (
      SELECT doc_id, k, substr(h, 1000 * k + 1, 1798) AS piece
      FROM (SELECT *, unnest(range(0, len(h) // 1000 + 1)) AS k FROM h)
    ), s AS (
      SELECT doc_id, 500 * k + p AS p, md5(substr(piece, 2 * p + 1, 800)) AS string
      FROM (SELECT *, unnest(range(0, len(piece) // 2 - 399)) AS p FROM pieces)
    ), again AS (SELECT string FROM s GROUP BY string HAVING count(*) > 1),
    marked AS (
      SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, true) AS fresh
      FROM s JOIN again USING (string)
    ), numbered AS (
      SELECT doc_id, p, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked
    ), spans AS (
      SELECT doc_id, span, min(p) AS first, max(p) + 400 AS past FROM numbered GROUP BY ALL
    ), gaps AS (
      SELECT doc_id, span, past AS first,
        lead(first) OVER (PARTITION BY doc_id ORDER BY span) AS past FROM spans
      UNION ALL SELECT doc_id, 0, 0, first FROM spans WHERE span = 1
    ), kept AS (
      SELECT doc_id, string_agg(CASE WHEN past IS NULL THEN substr(h, 2 * first + 1)
        ELSE substr(h, 2 * first + 1, 2 * (past - first)) END, '' ORDER BY span) AS kept
      FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
    ), removed AS (
      SELECT doc_id, sum(past - first)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
    )
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
           coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM h LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _more(state: str, cost: object, letter: str) -> str:
    """A state with one more edit: twelve digits of cost and the edits, so the least text is best."""
    spent = f"lpad((left({state}, 12)::BIGINT + {cost})::VARCHAR, 12, '0')"
    return f"{spent} || substr({state}, 13) || '{letter}'"


_SPACE = r"[\x20\x09-\x0D]"

#: The checksum bit by bit, then a walk over the rows of all conversations with the best text of
#: edits that ends before anything (b), after system (s), user (u) and assistant (a).
TURN_REPAIR = rf"""
    WITH RECURSIVE named AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
      FROM conversations
    ), sums AS (
      SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(name, ''), lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) % 20 AS chance
      FROM named
    ), damaged AS (
      SELECT conv_id, turn, CASE chance WHEN 4 THEN 'user' ELSE role END AS role,
        CASE chance WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE chance WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM sums
    ), placed AS (
      SELECT *, row_number() OVER o AS i, lag(left(role, 1)) OVER o || left(role, 1) AS pair,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
        regexp_replace(text, '{_SPACE}+$', '') AS body
      FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
    ), r AS (
      SELECT conv_id, i, turn, role, text, pair, left(role, 1) AS initial, CASE WHEN body = '' THEN 'blank'
        WHEN seen THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
      FROM placed
    ), walk AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000000' AS b, NULL::VARCHAR AS s, NULL::VARCHAR AS u,
        NULL::VARCHAR AS a FROM damaged
      UNION ALL
      SELECT conv_id, i, {_more('b', 2, 'D')},
        least({_more('s', 2, 'D')}, CASE WHEN initial = 's' AND stays THEN {_more('b', 'more', 'K')} END),
        least({_more('u', 2, 'D')}, CASE WHEN stays THEN CASE WHEN initial = 'u'
          THEN {_more('least(b, s, a)', 'more', 'K')} ELSE {_more('least(b, s, a)', '1 + more', 'R')} END END),
        least({_more('a', 2, 'D')}, CASE WHEN stays THEN CASE WHEN initial = 'a'
          THEN {_more('u', 'more', 'K')} ELSE {_more('u', '1 + more', 'R')} END END)
      FROM (
        SELECT r.conv_id, r.i, initial, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays,
          CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, b, s,
          least(u, {_more('least(b, s, a)', 5, 'I')}) AS u, least(a, {_more('u', 5, 'I')}) AS a
        FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i + 1
      )
    ), ended AS (
      SELECT conv_id, least(b, a, {_more('u', 5, 'I')}) AS best
      FROM (SELECT *, i = max(i) OVER (PARTITION BY conv_id) AS at_end FROM walk) WHERE at_end
    ), letters AS (
      SELECT conv_id, unnest(string_split(substr(best, 13), '')) AS letter,
        generate_subscripts(string_split(substr(best, 13), ''), 1) AS spot FROM ended
    ), counted AS (
      SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS n
      FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY spot)
    ), kept AS (
      SELECT c.conv_id, spot, n, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, role,
        max(CASE WHEN n = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END)
          OVER (PARTITION BY c.conv_id) AS system
      FROM counted c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i AND letter <> 'I'
      WHERE letter <> 'D'
    ), repaired AS (
      SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - system) % 2 = 1 THEN 'user'
        ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot)) AS digest FROM kept GROUP BY conv_id
    ), faults AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM r GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
      coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      coalesce(left(best, 12)::BIGINT, 0) AS cost, coalesce(substr(best, 13), '') AS audit,
      coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM o.conv_id"""
