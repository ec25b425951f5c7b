"""DuckDB SQL that the native and exact operators are checked against."""

from __future__ import annotations

from noteframe.llm import licences, prefix_trie, quality, quotes, vectors

_WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    rules, fences = quality.RULES, quality.FENCES
    ratios = {
        "symbol_ratio": "n_symbols::DOUBLE / word_chars",
        "dup_line_ratio": "n_dup_lines::DOUBLE / n_lines",
        "word_length": "word_chars::DOUBLE / n_words",
    }

    def quantiles(where: str) -> str:
        each = [f"quantile_disc({n}, {q}) AS {n}_{at}" for n in fences for q, at in ((0.25, "q1"), (0.75, "q3"))]
        return f"SELECT {where} count(*) AS n, {', '.join(each)} FROM ratios WHERE n_words >= {rules.min_words}"

    def limit(name: str, at: str) -> str:
        return (
            f"CASE WHEN g.n >= {rules.min_group} THEN g.{name}_{at} WHEN l.n >= {rules.min_group} THEN l.{name}_{at}"
            f" ELSE a.{name}_{at} END AS {name}_{at}"
        )

    odd = []
    for name, fence in fences.items():
        reach = f"{fence.k} * greatest({name}_q3 - {name}_q1, {fence.least_spread})"
        odd.append(f"coalesce({name} > {name}_q3 + {reach}, false)")
        if fence.two_sided:
            odd.append(f"coalesce({name} < {name}_q1 - {reach}, false)")
    return f"""
    WITH texts AS (
      SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    parts AS (
      SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM texts),
    windows AS (
      SELECT rid, pos, array_to_string(words[pos:pos + 7], ' ') AS win
      FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS pos FROM parts WHERE len(words) >= 8)),
    repeats AS (
      SELECT rid, count(DISTINCT pos + k) AS n_repeat_words
      FROM (SELECT rid, pos FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1), range(8) r(k)
      GROUP BY rid),
    counts AS (
      SELECT p.doc_id, p.lang, p.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM parts p LEFT JOIN repeats USING (rid)),
    ratios AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in ratios.items())} FROM counts),
    by_group AS ({quantiles('lang, source,')} GROUP BY lang, source),
    by_lang AS ({quantiles('lang,')} GROUP BY lang),
    all_docs AS ({quantiles('')}),
    limits AS (
      SELECT g.lang, g.source, {', '.join(limit(n, at) for n in fences for at in ('q1', 'q3'))}
      FROM by_group g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang, all_docs a),
    judged AS (
      SELECT r.*, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
        {' OR '.join(odd)} AS odd
      FROM ratios r LEFT JOIN limits l
        ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT odd AS kept
    FROM judged"""


_COMPONENTS = """
    sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
    least_of AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)"""


def near_dup_sql(words: int = 4, percent: int = 80) -> str:
    return f"""
    WITH RECURSIVE parts AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '{_WORD}') AS words
      FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i + {words - 1}], ' '))) END AS s
      FROM parts),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (
      SELECT p.doc_id AS a, q.doc_id AS b FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id < q.doc_id
      GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))),
    {_COMPONENTS}
    SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
    FROM sets LEFT JOIN least_of ON a = doc_id"""


def near_vectors_sql() -> str:
    return f"""
    WITH RECURSIVE good AS (
      SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
      WHERE list_cosine_similarity(p.v, q.v) >= {vectors.PLAN.cosine}),
    {_COMPONENTS},
    counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
    FROM embeddings LEFT JOIN least_of l ON l.a = vec_id LEFT JOIN counted k ON k.a = vec_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences_sql() -> str:
    clean = "low"
    for pattern, new in licences.SPELLINGS:
        new = new.replace("{1}", r"\1").replace("{2}", r"\2")
        clean = f"regexp_replace({clean}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    known = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, texts in licences.KNOWN.items() for t in texts)
    low = f"translate(line, '{licences.UPPER}', '{licences.LOWER}')"

    def canonical(rows: str, keys: str) -> str:
        return f"""
          SELECT {keys}, no, CASE WHEN regexp_matches(low, {_quoted(licences.COPYRIGHT_LINE)}) THEN '' ELSE trim({clean}) END AS c
          FROM (SELECT {keys}, no, {low} AS low FROM (
            SELECT {keys}, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM {rows}))"""

    whole = "string_agg(c, ' ' ORDER BY no) FILTER (c <> '')"
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    known AS (SELECT row_number() OVER () AS kid, * FROM (VALUES {known}) k(license_id, text)),
    known_lines AS ({canonical('known', 'kid, license_id')}),
    known_whole AS (SELECT kid, license_id, {whole} AS c FROM known_lines GROUP BY kid, license_id),
    digests AS (SELECT sha256(c) AS digest, min(license_id) AS license_id FROM known_whole GROUP BY sha256(c)),
    lines AS ({canonical('texts', 'rid, doc_id')}),
    units AS (
      SELECT doc_id, no AS line, c FROM lines WHERE c <> ''
      UNION ALL SELECT doc_id, 0, {whole} FROM lines GROUP BY rid, doc_id)
    SELECT doc_id, line::INTEGER AS line, license_id, digest
    FROM (SELECT *, sha256(c) AS digest FROM units WHERE c IS NOT NULL) JOIN digests USING (digest)"""


def quotes_sql() -> str:
    quote, attribution = _quoted(quotes.QUOTE), _quoted(quotes.ATTRIBUTION)

    def normal(text: str) -> str:
        return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    def escaped(text: str) -> str:
        return f"regexp_replace({text}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"

    return f"""
    WITH RECURSIVE raw AS (
      SELECT row_number() OVER () AS rid, conv_id, turn, role,
        translate(coalesce(text, ''), chr(1) || chr(2) || chr(13), '') AS text FROM conversations),
    cut_up AS (
      SELECT rid, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM raw),
    every AS (
      SELECT rid, i, length(regexp_replace(regexp_extract(line, {quote}, 1), '[^>]', '', 'g')) AS level,
        regexp_replace(line, {quote}, '') AS content FROM cut_up),
    lines AS (
      SELECT * FROM (SELECT *, lead(level, 1, 0) OVER (PARTITION BY rid ORDER BY i) AS below FROM every)
      WHERE NOT (level = 0 AND below > 0 AND regexp_matches(content, {attribution}))),
    flagged AS (
      SELECT *, CASE WHEN lag(level) OVER w = level AND trim(lag(content) OVER w) <> '' AND trim(content) <> ''
        THEN 0 ELSE 1 END AS starts
      FROM lines WINDOW w AS (PARTITION BY rid ORDER BY i)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS run FROM flagged),
    runs AS (SELECT rid, level, string_agg(content, chr(10) ORDER BY i) AS passage FROM numbered GROUP BY rid, run, level),
    passages AS (SELECT * FROM runs WHERE {normal('passage')} <> ''),
    bodies AS (
      SELECT rid, regexp_replace(regexp_replace(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0),
        '^\\s+|\\s+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM lines GROUP BY rid),
    said AS (
      SELECT rid, level, passage AS t FROM passages UNION ALL SELECT rid, level, unnest(string_split(passage, chr(10))) FROM passages
      UNION ALL SELECT rid, 0, body FROM bodies WHERE body IS NOT NULL
      UNION ALL SELECT rid, 0, unnest(string_split(body, chr(10))) FROM bodies WHERE body IS NOT NULL
      UNION ALL SELECT rid, level, unnest(regexp_split_to_array(passage, '[.!?]+[ \t\n]+')) FROM passages
      UNION ALL SELECT rid, 0, unnest(regexp_split_to_array(body, '[.!?]+[ \t\n]+')) FROM bodies WHERE body IS NOT NULL),
    keyed AS (
      SELECT conv_id, turn, level, {normal('t')} AS key FROM said JOIN raw USING (rid)
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    sources AS (SELECT conv_id, key, min(turn) AS source FROM keyed WHERE level = 0 AND key <> '' GROUP BY conv_id, key),
    links AS (
      SELECT k.conv_id, k.turn, arg_max(source, (-level, source)) AS parent_turn FROM keyed k JOIN sources s USING (conv_id, key)
      WHERE level > 0 AND source < k.turn GROUP BY k.conv_id, k.turn),
    climb AS (
      SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM links
      UNION ALL SELECT c.conv_id, c.turn, l.parent_turn, depth + 1 FROM climb c JOIN links l ON c.conv_id = l.conv_id AND c.up = l.turn),
    tops AS (SELECT conv_id, turn, min(up) AS thread_turn, max(depth) AS depth FROM climb GROUP BY conv_id, turn),
    levels AS (
      SELECT rid, count(*) FILTER (level > 0) AS n_quotes, max(level) AS max_level FROM passages GROUP BY rid)
    SELECT r.conv_id, r.turn, r.role, coalesce(body, '') AS body, coalesce(n_quotes, 0) AS n_quotes,
      coalesce(max_level, 0)::BIGINT AS max_level, parent_turn, coalesce(thread_turn, r.turn) AS thread_turn,
      coalesce(depth, 0)::BIGINT AS depth,
      '<|' || {escaped("coalesce(role, 'unknown')")} || '|>' || chr(10) || {escaped("coalesce(body, '')")} || chr(10) AS formatted
    FROM raw r LEFT JOIN bodies USING (rid) LEFT JOIN levels USING (rid)
    LEFT JOIN links l ON l.conv_id = r.conv_id AND l.turn = r.turn
    LEFT JOIN tops t ON t.conv_id = r.conv_id AND t.turn = r.turn"""


def prefix_trie_sql() -> str:
    plan = prefix_trie.PLAN
    crc = (
        "xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')],"
        " lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT for i in range(8)],"
        " lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )
    return f"""
    WITH given AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT conv_id, {crc} % {plan.heads} AS h,
        list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns
      FROM given GROUP BY conv_id),
    rebuilt AS (
      SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS whole
      FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - (o.conv_id % {plan.family} + {plan.family}) % {plan.family}),
    prefixes AS (
      SELECT conv_id, depth, len(whole) AS length, sha256(to_json(whole[1:depth])::VARCHAR) AS node,
        sha256(to_json(whole[1:depth - 1])::VARCHAR) AS parent, strlen(coalesce(whole[depth].text, '')) AS bytes
      FROM (SELECT *, unnest(range(0, len(whole) + 1)) AS depth FROM rebuilt)),
    nodes AS (
      SELECT node, depth, min(parent) AS parent, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
      FROM prefixes GROUP BY node, depth),
    children AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
    below AS (
      SELECT p.node, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (c.parent IS NULL) AS n_leaves
      FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.parent = n.node
      GROUP BY p.node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves,
      b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b USING (node) LEFT JOIN children c ON c.parent = n.node
    LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent"""


SQL = {
    "op2_minhash_near_dedup": near_dup_sql(),
    "op4_quotation_linking": quotes_sql(),
    "op5_quality_rules": quality_sql(),
    "op6_inverted_multi_index": near_vectors_sql(),
    "op10_license_scans": licences_sql(),
    "op13_prefix_trie": prefix_trie_sql(),
}
