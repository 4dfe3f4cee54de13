"""SQL building blocks of the oracles. ``with_parts`` strings together the common
table expressions a query needs, in order."""

from __future__ import annotations

from textloom.functions.draws import MODULUS, ROUND_1, ROUND_2, ROUND_3, SHIFT_1, SHIFT_2, STEP

SEED = 12345


def seed(*keys: str) -> str:
    """SQL for ``draws.seed``; plain words are quoted by the caller."""
    joined = " || '|' || ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT % {MODULUS})"


def unit(x: str) -> str:
    return f"((({x}) + 0.5::DOUBLE) / {MODULUS}.0::DOUBLE)"


def mix(seed_sql: str, index: str) -> str:
    """SQL for one draw of ``draws.mix``."""
    h = f"(({seed_sql} + ({index})::BIGINT * {STEP}) % {MODULUS} * {ROUND_1} % {MODULUS})"
    h = f"list_transform([{h}], lambda h: xor(h, h >> {SHIFT_1}) * {ROUND_2} % {MODULUS})"
    return f"list_transform({h}, lambda h: xor(h, h >> {SHIFT_2}) * {ROUND_3} % {MODULUS})[1]"


PUNCT = "[!-/:-@\\[-`{-~\\pP]"
NOT_WORD = "\\s!-/:-@\\[-`{-~\\pP"
# each word with its position in the corpus
PARTS: dict[str, str] = {
    "lines": """
lines AS (
  SELECT source AS shard, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no
  FROM (SELECT source, doc_id,
               list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))),
                           lambda x: x <> '') AS ls
        FROM documents))""",
    "words": f"""
words AS (
  SELECT shard, doc_id, line_no, unnest(ws) AS word, unnest(range(len(ws))) AS word_no
  FROM (SELECT *, regexp_extract_all(line, '{PUNCT}|[^{NOT_WORD}]+') AS ws FROM lines))""",
    "vocab": """
word_counts AS (SELECT word, count(*) AS n FROM words GROUP BY word),
vocab_words AS (SELECT word AS token FROM word_counts ORDER BY n DESC, word LIMIT 1500),
vocab_chars AS (
  SELECT c FROM (SELECT unnest(string_split(word, '')) AS c, n FROM word_counts)
  GROUP BY c ORDER BY sum(n) DESC, c LIMIT 60),
vocab_head AS (
  SELECT unnest(h) AS token, unnest(range(len(h))) AS id
  FROM (SELECT ['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '<s>', '</s>']
               || list_transform(range(10), lambda i: '[unused' || i || ']') AS h)),
vocab_body AS (
  SELECT token FROM vocab_words UNION SELECT c FROM vocab_chars UNION SELECT '##' || c FROM vocab_chars),
vocab AS (
  SELECT token, id::INTEGER AS id FROM vocab_head
  UNION ALL
  SELECT token, (16 + row_number() OVER (ORDER BY token))::INTEGER
  FROM vocab_body WHERE token NOT IN (SELECT token FROM vocab_head))""",
    "pieces": """
distinct_words AS (SELECT DISTINCT word FROM words),
word_starts AS (
  SELECT word, unnest(range(len(word))) AS beg FROM distinct_words WHERE len(word) <= 100),
word_spans AS (
  SELECT word, beg, unnest(range(1, least(len(word) - beg, (SELECT max(len(token)) FROM vocab)) + 1)) AS size
  FROM word_starts),
best AS (
  SELECT s.word, s.beg, max(s.size) AS size
  FROM word_spans s
  JOIN vocab v ON v.token = (CASE WHEN s.beg > 0 THEN '##' ELSE '' END) || substr(s.word, s.beg + 1, s.size)
  GROUP BY s.word, s.beg),
walk AS (
  SELECT word, beg, size FROM best WHERE beg = 0
  UNION ALL
  SELECT b.word, b.beg, b.size FROM walk w JOIN best b ON b.word = w.word AND b.beg = w.beg + w.size),
walked AS (
  SELECT word, sum(size) AS covered,
         list((CASE WHEN beg > 0 THEN '##' ELSE '' END) || substr(word, beg + 1, size) ORDER BY beg) AS toks
  FROM walk GROUP BY word),
pieces AS (
  SELECT d.word, CASE WHEN w.covered = len(d.word) THEN w.toks ELSE ['[UNK]'] END AS toks
  FROM distinct_words d LEFT JOIN walked w ON w.word = d.word)""",
    "line_tokens": """
line_tokens AS (
  SELECT shard, doc_id, line_no, flatten(list(toks ORDER BY word_no)) AS toks
  FROM words JOIN pieces USING (word) GROUP BY shard, doc_id, line_no),
numbered AS (
  SELECT *, len(toks) AS n, row_number() OVER (PARTITION BY shard ORDER BY doc_id, line_no) AS rn
  FROM line_tokens)""",
    "packed": """
packed AS (
  SELECT shard, rn, 0::BIGINT AS grp, n AS acc FROM numbered WHERE rn = 1
  UNION ALL
  SELECT l.shard, l.rn, CASE WHEN p.acc >= 512 THEN p.grp + 1 ELSE p.grp END,
         CASE WHEN p.acc >= 512 THEN l.n ELSE p.acc + l.n END
  FROM packed p JOIN numbered l ON l.shard = p.shard AND l.rn = p.rn + 1)""",
    "grouped": """
grouped AS (
  SELECT shard, grp, flatten(list(toks ORDER BY rn)) AS toks, count(*) AS n_lines
  FROM packed JOIN numbered USING (shard, rn) GROUP BY shard, grp)""",
    "chunks": """
chunks AS (
  SELECT shard, grp, chunk, toks[chunk * 510 + 1 : chunk * 510 + 510] AS toks
  FROM (SELECT *, unnest(range(CASE WHEN len(toks) >= 921 THEN (len(toks) + 509) // 510 ELSE 1 END)) AS chunk
        FROM grouped))""",
    "framed": f"""
framed AS (
  SELECT shard, dupe, grp, chunk, ['[CLS]'] || toks || ['[SEP]'] AS toks,
         least(76, greatest(1, round_even((len(toks) + 2) * 0.15::DOUBLE, 0)::BIGINT)) AS budget,
         {seed(str(SEED), "'select'", "shard", "dupe", "grp", "chunk")} AS select_seed,
         {seed(str(SEED), "'corrupt'", "shard", "dupe", "grp", "chunk")} AS corrupt_seed
  FROM chunks, (SELECT unnest([0, 1]) AS dupe))""",
    "spans": """
framed_tokens AS (
  SELECT shard, grp, chunk, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM framed WHERE dupe = 0),
token_kinds AS (
  SELECT *, tok IN ('<s>', '</s>', '[UNK]', '[SEP]', '[PAD]', '[CLS]', '[MASK]') AS special
  FROM framed_tokens),
token_starts AS (
  SELECT *, NOT special AND (tok NOT LIKE '##%' OR lag(special) OVER w) AS starts
  FROM token_kinds WINDOW w AS (PARTITION BY shard, grp, chunk ORDER BY pos)),
token_words AS (
  SELECT *, sum(starts::INTEGER) OVER (PARTITION BY shard, grp, chunk ORDER BY pos) AS word_id
  FROM token_starts),
spans AS (
  SELECT shard, grp, chunk, word_id, min(pos) AS b, max(pos) + 1 AS e
  FROM token_words WHERE NOT special GROUP BY shard, grp, chunk, word_id)""",
    "ngrams": """
ngrams AS (
  SELECT shard, grp, chunk, 1 AS n, b, e FROM spans
  UNION ALL
  SELECT shard, grp, chunk, 2, b, e2 FROM (
    SELECT *, lead(b) OVER w AS b2, lead(e) OVER w AS e2 FROM spans
    WINDOW w AS (PARTITION BY shard, grp, chunk ORDER BY b))
  WHERE b2 = e)""",
    "chosen": f"""
shuffled AS (
  SELECT f.shard, f.dupe, f.grp, f.chunk, f.budget, f.select_seed, g.n, g.b, g.e,
         row_number() OVER (PARTITION BY f.shard, f.dupe, f.grp, f.chunk, g.n
                            ORDER BY {mix("f.select_seed", "g.b * 32 + g.n")}, g.b) - 1 AS rank
  FROM framed f JOIN ngrams g ON g.shard = f.shard AND g.grp = f.grp AND g.chunk = f.chunk),
timed AS (
  SELECT *, sum(-ln({unit(mix("select_seed", "(rank * 2 + 1) * 16 + n"))}) * n)
              OVER (PARTITION BY shard, dupe, grp, chunk, n ORDER BY rank) AS arrival
  FROM shuffled),
ranked AS (
  SELECT shard || '|' || dupe || '|' || grp || '|' || chunk AS ex, budget, b, e,
         row_number() OVER (PARTITION BY shard, dupe, grp, chunk ORDER BY arrival, n) AS k
  FROM timed),
greedy AS (
  SELECT ex, budget, k, CASE WHEN e - b <= budget THEN [{{'b': b, 'e': e}}] ELSE [] END AS spans,
         CASE WHEN e - b <= budget THEN e - b ELSE 0 END AS used
  FROM ranked WHERE k = 1
  UNION ALL
  SELECT ex, budget, k, CASE WHEN ok THEN list_append(spans, {{'b': b, 'e': e}}) ELSE spans END,
         CASE WHEN ok THEN used + e - b ELSE used END
  FROM (SELECT g.ex, g.budget, r.k, g.spans, g.used, r.b, r.e,
               g.used + r.e - r.b <= g.budget
                 AND len(list_filter(g.spans, lambda s: s.b < r.e AND r.b < s.e)) = 0 AS ok
        FROM greedy g JOIN ranked r ON r.ex = g.ex AND r.k = g.k + 1 WHERE g.used < g.budget)),
chosen AS (
  SELECT ex, unnest(spans).b AS b, unnest(spans).e AS e
  FROM (SELECT ex, arg_max(spans, k) AS spans FROM greedy GROUP BY ex))""",
    "masked": f"""
replacements AS (
  SELECT token, row_number() OVER (ORDER BY id) - 1 AS i FROM vocab WHERE NOT regexp_matches(token, '^\\[unused.*\\]$')),
acted AS (
  SELECT f.*, f.shard || '|' || f.dupe || '|' || f.grp || '|' || f.chunk AS ex, c.b, c.e,
         {unit(mix("f.corrupt_seed", "c.b * 2"))} AS u
  FROM framed f JOIN chosen c ON c.ex = f.shard || '|' || f.dupe || '|' || f.grp || '|' || f.chunk),
acted_pos AS (SELECT *, unnest(range(b, e)) AS pos FROM acted),
masked AS (
  SELECT a.ex, a.shard, a.dupe, a.grp, a.chunk, a.pos, a.toks[a.pos + 1] AS label,
         CASE WHEN a.u < 0.8 THEN '[MASK]' WHEN a.u < 0.9 THEN a.toks[a.pos + 1] ELSE r.token END AS new_tok
  FROM acted_pos a
  JOIN replacements r ON r.i = {mix("a.corrupt_seed", "a.pos * 2 + 1")} % (SELECT count(*) FROM replacements))""",
}
ORDER = list(PARTS)


def with_parts(last: str, body: str) -> str:
    """All parts up to ``last``, then the query."""
    return "WITH RECURSIVE " + ",".join(PARTS[p] for p in ORDER[: ORDER.index(last) + 1]) + "\n" + body
