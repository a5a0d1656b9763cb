"""DuckDB SQL with the same results as the registered queries that SQL can express."""

from __future__ import annotations

from folioscope.functions.text import SPACE
from folioscope.functions.words import BM25, DOLLARS_PER_MILLION, STOP_WORDS, VAGUE_WORDS

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TRIM = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_COLLAPSE = lambda x: _TRIM(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")
_SQUASH = lambda x: f"regexp_replace({x}, '[{SPACE}]+', '', 'g')"
_SHORT = lambda x: rf"regexp_replace({x}, '^contents/handbook/|\.md$', '', 'g')"
_TOKENS = lambda x: (
    rf"list_filter(list_concat(regexp_split_to_array({x}, '[\n\r\p{{Z}}\p{{P}}]+'), "
    rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+(?:[_\-./@:][\p{{L}}\p{{N}}]+)+')), lambda w: w <> '')"
)
_IS_TERM = lambda w: (
    rf"len(list_filter(regexp_split_to_array(lower({w}), '[_\-./@:]'), lambda p: NOT list_contains({_LIST(STOP_WORDS)}, p))) > 0"
)
_TERMS = lambda x: f"list_transform(list_filter({_TOKENS(x)}, lambda w: {_IS_TERM('w')}), lambda w: lower(w))"
_WORDS = lambda x: (
    rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}$]+'), lambda w: NOT list_contains({_LIST(VAGUE_WORDS)}, w))"
)
# DuckDB knows NFC only: wide letters and ligatures, which the given tables have, are replaced before it.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''"), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NFKC = lambda x: (
    f"nfc_normalize(replace(replace(replace(replace(replace(translate({x}, '{_WIDE[0]}', '{_WIDE[1]}'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'))"
)
_BLOCKS = "SELECT DISTINCT * FROM blocks WHERE section_id IS NOT NULL AND block_ord IS NOT NULL"
_ANSWERS = "SELECT * FROM answer_eval WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY saved_at) = 1"
_QUESTIONS = "SELECT * FROM questions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY question) = 1"
_CHUNKS = "SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_ord) = 1"
_PASSAGES = (
    "SELECT chunk_id, coalesce(title, '') AS title, coalesce(body, '') AS body FROM keyword_index "
    "WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY title) = 1"
)
_BODY = "array_to_string(list_transform(pages, lambda p: coalesce(p.text, '')), chr(10))"
_VECTORS = (
    "SELECT chunk_ord, any_value(CAST(embedding AS DOUBLE[])) AS e FROM vectors WHERE chunk_ord IS NOT NULL "
    "AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 "
    "AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_ord"
)


def _ranked(near: int = 0, name: str = "ranked") -> str:
    """Common table expressions ending in ``name``(query, rank, chunk_id, similarity)."""
    return f"""
        v{near} AS ({_VECTORS}), c{near} AS ({_CHUNKS}),
        s{near} AS (
            SELECT q.chunk_ord AS query_ord, x.chunk_ord, round(list_cosine_similarity(q.e, x.e), 6) AS similarity
            FROM v{near} q, v{near} x WHERE (q.chunk_ord - {near}) % 50 = 0
        ),
        r{near} AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_ord ORDER BY similarity DESC, chunk_ord) AS INTEGER) AS rank
            FROM s{near} QUALIFY rank <= 12
        ),
        {name} AS (
            SELECT query_ord - {near} AS query, rank, chunk_id, similarity FROM r{near} JOIN c{near} USING (chunk_ord)
        )"""


def _bm25(wanted: str) -> str:
    """Common table expressions ending in scores(id, chunk_id, score), for a query giving (id, term)."""
    k, b, d, boost = BM25["k"], BM25["b"], BM25["d"], BM25["title_boost"]
    return f"""
        passages AS ({_PASSAGES}),
        fields AS (
            SELECT chunk_id, 'title' AS field, {_TERMS("title")} AS terms FROM passages
            UNION ALL SELECT chunk_id, 'body', {_TERMS("body")} FROM passages
        ),
        lengths AS (SELECT field, count(*) AS collection, avg(len(terms)) AS average FROM fields GROUP BY field),
        held AS (
            SELECT chunk_id, field, field_length, term, count(*) AS tf
            FROM (SELECT chunk_id, field, len(terms) AS field_length, unnest(terms) AS term FROM fields) GROUP BY ALL
        ),
        df AS (SELECT field, term, count(*) AS n FROM held GROUP BY field, term),
        wanted AS (SELECT DISTINCT id, term FROM ({wanted})),
        scores AS (
            SELECT id, chunk_id, round(sum(
                (CASE WHEN field = 'title' THEN {boost} ELSE 1.0 END) * ln(1 + (collection - n + 0.5) / (n + 0.5))
                * ({d} + tf * ({k} + 1) / (tf + {k} * (1 - {b} + {b} * field_length / average)))), 6) AS score
            FROM held JOIN df USING (field, term) JOIN lengths USING (field) JOIN wanted USING (term)
            GROUP BY id, chunk_id
        )"""


def _rare(questions: str) -> str:
    """Common table expressions ending in rare(id, position, word, term, passages)."""
    return f"""
        frequency AS (
            SELECT term, count(*) AS passages FROM (
                SELECT DISTINCT chunk_id, unnest({_TERMS("title || ' ' || body")}) AS term FROM ({_PASSAGES})
            ) GROUP BY term HAVING count(*) <= 3
        ),
        words AS (
            SELECT id, unnest({_TOKENS("question")}) AS word, unnest(range(len({_TOKENS("question")}))) AS position FROM ({questions})
        ),
        rare AS (
            SELECT id, CAST(position AS INTEGER) AS position, word, term, passages
            FROM (SELECT *, lower(word) AS term FROM words WHERE {_IS_TERM("word")}) JOIN frequency USING (term)
        )"""


_QUESTION_TERMS = f"SELECT id, unnest({_TERMS('question')}) AS term FROM ({_QUESTIONS})"
_TOP12 = (
    "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score "
    "FROM scores QUALIFY rank <= 12"
)
_EVIDENCE = f"""
    SELECT DISTINCT q.id, c.chunk_id FROM (
        SELECT id, unnest(expect) AS section, {_COLLAPSE(r"regexp_extract(evidence, '^p\d+: (.+)$', 1)")} AS quote
        FROM ({_QUESTIONS}) WHERE NOT coalesce(out_of_scope, FALSE)
    ) q
    JOIN ({_CHUNKS}) c ON {_SHORT("c.section_path")} = {_SHORT("q.section")}
    JOIN ({_PASSAGES}) p ON p.chunk_id = c.chunk_id
    WHERE q.quote <> '' AND contains({_COLLAPSE("p.title || chr(10) || chr(10) || p.body")}, q.quote)
"""
_EVALUATED = f"""
    WITH {_bm25(_QUESTION_TERMS)}, ranked AS ({_TOP12}), targets AS ({_EVIDENCE}),
    hits AS (SELECT id, min(rank) AS search_rank FROM ranked SEMI JOIN targets USING (id, chunk_id) GROUP BY id),
    evaluated AS (
        SELECT q.id, search_rank FROM ({_QUESTIONS}) q LEFT JOIN hits USING (id) WHERE NOT coalesce(out_of_scope, FALSE)
    )
"""
_SEARCHED = f"""
    WITH {_bm25(_QUESTION_TERMS)}, ranked AS ({_TOP12}), targets AS ({_EVIDENCE}),
    {_rare(_QUESTIONS)},
    rare_scores AS (
        SELECT id, chunk_id, round(sum((CASE WHEN field = 'title' THEN {BM25["title_boost"]} ELSE 1.0 END)
            * ln(1 + (collection - n + 0.5) / (n + 0.5))
            * ({BM25["d"]} + tf * ({BM25["k"]} + 1) / (tf + {BM25["k"]} * (1 - {BM25["b"]} + {BM25["b"]} * field_length / average)))), 6) AS score
        FROM held JOIN df USING (field, term) JOIN lengths USING (field) JOIN (SELECT DISTINCT id, term FROM rare) USING (term)
        GROUP BY id, chunk_id
    ),
    matched AS (SELECT id, chunk_id FROM rare_scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) = 1),
    fresh AS (
        SELECT m.id, CASE WHEN coalesce(s.size, 0) < 12 THEN coalesce(s.size, 0) + 1 ELSE 12 END AS rank, m.chunk_id FROM matched m
        LEFT JOIN (SELECT id, max(rank) AS size FROM ranked GROUP BY id) s USING (id)
        ANTI JOIN ranked r ON r.id = m.id AND r.chunk_id = m.chunk_id
    ),
    found AS (
        SELECT id, rank, chunk_id FROM ranked r ANTI JOIN fresh f ON f.id = r.id AND f.rank = r.rank
        UNION ALL SELECT id, rank, chunk_id FROM fresh
    ),
    searched AS (
        SELECT q.id,
            (SELECT min(r.rank) FROM ranked r SEMI JOIN targets t ON t.id = r.id AND t.chunk_id = r.chunk_id WHERE r.id = q.id) AS ranked_rank,
            CAST((SELECT min(r.rank) FROM found r SEMI JOIN targets t ON t.id = r.id AND t.chunk_id = r.chunk_id WHERE r.id = q.id) AS INTEGER) AS search_rank,
            (SELECT CASE WHEN count(t.id) > 0 THEN 'added the answer' WHEN count(*) > 0 THEN 'added another passage' END
                FROM fresh f LEFT JOIN targets t ON t.id = f.id AND t.chunk_id = f.chunk_id WHERE f.id = q.id) AS keyword_net,
            EXISTS (SELECT 1 FROM found r JOIN ({_CHUNKS}) c USING (chunk_id) WHERE r.id = q.id
                AND list_contains(list_transform(q.expect, lambda x: {_SHORT("x")}), {_SHORT("c.section_path")})) AS section_hit
        FROM ({_QUESTIONS}) q WHERE NOT coalesce(q.out_of_scope, FALSE)
    )
"""
_RESEARCHED = f"""
    WITH {_ranked()}, {_ranked(1, "one")}, {_ranked(2, "two")}, {_ranked(3, "three")},
    hits AS (
        SELECT query, 1 AS search, rank, chunk_id FROM one UNION ALL SELECT query, 2, rank, chunk_id FROM two
        UNION ALL SELECT query, 3, rank, chunk_id FROM three
    ),
    first AS (
        SELECT h.* FROM hits h ANTI JOIN ranked r ON r.query = h.query AND r.chunk_id = h.chunk_id
        QUALIFY row_number() OVER (PARTITION BY h.query, h.chunk_id ORDER BY rank, search) = 1
    ),
    added AS (
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY rank, search) AS INTEGER) AS position, chunk_id
        FROM first QUALIFY position <= 8
    ),
    second AS (
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY list, rank) AS INTEGER) AS rank, chunk_id FROM (
            SELECT query, 0 AS list, rank, chunk_id FROM ranked UNION ALL SELECT query, 1, position, chunk_id FROM added
        )
    )
"""
# RE2 knows no lookaround: sentences are found by a mark put after each end, names and negations by their own patterns.
_SENTENCES = rf"string_split(regexp_replace(regexp_replace(regexp_replace(answer, '\[\d+\]', '', 'g'), '([.!?])[{SPACE}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
_NAMED = r"(?:handbook|passages?|excerpts?)"
_PARTS = f"""
    SELECT row_id, CAST(i - 1 AS INTEGER) AS part_ord, parts[i].text AS text, parts[i].citations AS citations, parts[i + 1] AS following
    FROM (SELECT row_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM ({_ANSWERS}) WHERE len(parts) > 0)
"""
_CLAIM = lambda t: (
    _TRIM(
        rf"regexp_replace(regexp_replace({_TRIM(rf"regexp_replace({t}, '(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]*', '', 'g')")}, "
        rf"'(^|[.!?])(?:^|[{SPACE}]+)?[^.!?]*:$', '\1'), '[^\p{{L}}\p{{N}}{SPACE}]', ' ', 'g')"
    )
)
_IS_CLAIM = lambda t: (
    rf"{_CLAIM(t)} <> '' AND NOT regexp_full_match(lower({_CLAIM(t)}), '(?:and|or|but|also|so|then|plus|while|whereas)') "
    rf"AND NOT regexp_full_match(lower({_CLAIM(t)}), '(?:the handbook|it|they)[{SPACE}]+(?:also[{SPACE}]+)?(?:says?|adds?|notes?|states?|explains?)(?:[{SPACE}]+that)?')"
)

_DOUBT = rf"""
    len(list_filter({_SENTENCES}, lambda s: regexp_matches(
        regexp_replace(s, '(?i)\b(?:handbook|passages?|excerpts?)(?:[''’]s|[{SPACE}]+(?:says|states|notes|explains|adds)\b)', 'X', 'g'),
        '(?i)\b(?:handbook|passages?|excerpts?)\b[^.!?\n]{{0,40}}?(?:\b(?:not|no|never|nothing|none)\b|n[''’]t\b)'))) > 0
"""
_GRADED = f"""
    SELECT a.row_id, a.id, a.kind, a.outcome, CASE
        WHEN coalesce(q.out_of_scope, FALSE) THEN
            CASE a.status WHEN 'not-covered' THEN 'pass' WHEN 'answered' THEN 'review' ELSE 'fail' END
        WHEN NOT list_has_any(list_transform(coalesce(a.cited_sections, []), lambda x: {_SHORT("x")}),
            list_transform(coalesce(q.expect, []), lambda x: {_SHORT("x")})) THEN 'fail'
        WHEN coalesce(len(a.gaps), 0) > 0 OR coalesce({_DOUBT.replace("answer,", "a.answer,")}, FALSE) THEN 'review'
        ELSE 'pass' END AS grade
    FROM ({_ANSWERS}) a JOIN ({_QUESTIONS}) q ON q.id = a.id
"""
_LINES = f"""
    WITH b AS (
        SELECT section_id AS doc_id, block_ord AS page, coalesce(list_level, 0) AS lv,
            list_filter(string_split({_COLLAPSE("text")}, ' '), lambda w: w <> '') AS words
        FROM ({_BLOCKS}) WHERE kind = 'paragraph' AND text IS NOT NULL
    ),
    i AS (SELECT doc_id, page, lv, unnest(words) AS str, unnest(range(len(words))) AS n FROM b),
    x AS (
        SELECT *, n // 4 + n // 8 + CASE WHEN (n // 4) % 2 = 1 AND n % 4 = 3 THEN 1 ELSE 0 END AS line_ord, 50 + 30 * lv + (n % 4) * 120 AS x,
            CAST(700 - 16 * (n // 4) AS DOUBLE) - (n % 4) * CAST(CASE WHEN (n // 4) % 2 = 1 THEN 1.1 ELSE 0.9 END AS DOUBLE) AS y,
            least(length(str) * 5.5, 115.0) AS width
        FROM i
    ),
    g AS (SELECT *, x - lag(x + width) OVER (PARTITION BY doc_id, page, line_ord ORDER BY x) AS gap FROM x),
    lines AS (
        SELECT doc_id, page, CAST(line_ord AS INTEGER) AS line_ord, max(y) AS y,
            CAST(min(x) AS DOUBLE) AS x, CAST(max(x + width) AS DOUBLE) AS "right", CAST(11 AS DOUBLE) AS size,
            {_COLLAPSE(_NFKC("string_agg(CASE WHEN gap > 12 THEN ' | ' WHEN gap > 1 THEN ' ' ELSE '' END || str, '' ORDER BY x)"))} AS text
        FROM g GROUP BY doc_id, page, line_ord
    )
"""
_RESOLVED = f"""
    WITH c AS (
        SELECT chunk_id, chunk_ord, flatten(list_transform(list_filter(pages, lambda p: p.text IS NOT NULL),
            lambda p: list_transform(string_split(p.text, chr(10)), lambda t: {{'page': p.page, 'text': t}}))) AS b
        FROM ({_CHUNKS})
    ),
    e AS (
        SELECT row_id, part, CAST(unnest(range(len(numbers))) AS INTEGER) AS position, unnest(numbers) AS number FROM (
            SELECT row_id, CAST(i - 1 AS INTEGER) AS part, parts[i].citations AS numbers
            FROM (SELECT row_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM ({_ANSWERS}))
        )
    ),
    r AS (
        SELECT row_id, part, position, number, chunk_id, len(b) AS blocks, (row_id + position) % (len(b) + 1) AS start,
            1 + (row_id + number) % 3 AS length,
            b[(row_id + position) % (len(b) + 1) + 1:(row_id + position) % (len(b) + 1) + 1 + (row_id + number) % 3] AS q
        FROM e JOIN c ON c.chunk_ord = (e.row_id * 5 + e.number - 1) % (SELECT count(*) FROM c) WHERE number >= 1
    ),
    v AS (
        SELECT * FROM r WHERE start + length <= blocks AND (row_id + part) % 7 <> 0 AND (row_id + part) % 11 <> 0
    ),
    k AS (
        SELECT row_id, number, start, length, row_number() OVER (PARTITION BY row_id ORDER BY min(part * 1000000 + position)) AS n
        FROM v GROUP BY row_id, number, start, length
    ),
    resolved AS (
        SELECT row_id, part, position, CAST(n AS INTEGER) AS n, chunk_id,
            array_to_string(list_transform(list_filter(range(1, len(q) + 1), lambda i: NOT list_contains(list_transform(q[1:i - 1], lambda x: x.page), q[i].page)), lambda i: q[i].page), ',') AS pages,
            array_to_string(list_transform(q, lambda x: x.text), chr(10)) AS quote
        FROM v JOIN k USING (row_id, number, start, length)
    )
"""
_CUT = lambda rest: (
    f"CASE WHEN length({rest}) <= 1000 THEN NULL "
    + " ".join(
        f"WHEN length(regexp_extract(substr({rest}, 1, 1001), '{end}', 1)) > 0 THEN length(regexp_extract(substr({rest}, 1, 1001), '{end}', 1))"
        for end in ("(?s)^(.+[.!?]) ", "(?s)^(.+) ")
    )
    + " ELSE 1000 END"
)
# Paragraphs in pieces, then each piece in turn into the open chunk of its run of paragraphs, or into the next one.
_CHUNKED = rf"""
    WITH RECURSIVE b AS (SELECT *, kind = 'heading' AS h, coalesce(text, '') AS t FROM ({_BLOCKS})),
    w AS (
        SELECT *, coalesce(max(CASE WHEN h THEN block_ord END) OVER r, -1) AS run,
            max(CASE WHEN h AND level = 1 THEN block_ord END) OVER r AS pos1, max(CASE WHEN h AND level = 2 THEN block_ord END) OVER r AS pos2
        FROM b WINDOW r AS (PARTITION BY section_id ORDER BY block_ord)
    ),
    trails AS (
        SELECT w.section_id, w.block_ord AS run, CASE
            WHEN w.level = 1 THEN w.t WHEN w.level = 2 THEN concat_ws(' › ', b1.t, w.t)
            ELSE concat_ws(' › ', b1.t, CASE WHEN pos1 IS NULL OR pos2 > pos1 THEN b2.t END, w.t) END AS trail
        FROM w LEFT JOIN b b1 ON b1.section_id = w.section_id AND b1.block_ord = pos1
        LEFT JOIN b b2 ON b2.section_id = w.section_id AND b2.block_ord = pos2 WHERE w.h
    ),
    s AS (
        SELECT section_id, run, block_ord, page, -1 AS piece_ord, CAST(NULL AS VARCHAR) AS piece, CASE
            WHEN coalesce(list_level, 0) <= 0 THEN text
            WHEN coalesce(continued, FALSE) THEN repeat('  ', list_level) || text
            WHEN regexp_matches(text, '^\d+[.)][{SPACE}]') THEN repeat('  ', list_level - 1) || text
            ELSE repeat('  ', list_level - 1) || '- ' || text END AS rest
        FROM w WHERE kind = 'paragraph' AND text IS NOT NULL
        UNION ALL
        SELECT section_id, run, block_ord, page, piece_ord + 1,
            CASE WHEN cut IS NULL THEN rest ELSE regexp_replace(substr(rest, 1, cut), '[{SPACE}]+$', '') END,
            CASE WHEN cut IS NULL THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^[{SPACE}]+', '') END
        FROM (SELECT *, {_CUT("rest")} AS cut FROM s WHERE rest <> '')
    ),
    pieces AS (
        SELECT section_id, run, page, piece, row_number() OVER (PARTITION BY section_id, run ORDER BY block_ord, piece_ord) AS i
        FROM s WHERE piece_ord >= 0 AND piece <> ''
    ),
    packed AS (
        SELECT section_id, run, i, page, piece, 0 AS number, length(piece) AS size FROM pieces WHERE i = 1
        UNION ALL
        SELECT p.section_id, p.run, p.i, p.page, p.piece, CASE WHEN k.size + 1 + length(p.piece) > 1000 THEN k.number + 1 ELSE k.number END,
            CASE WHEN k.size + 1 + length(p.piece) > 1000 THEN length(p.piece) ELSE k.size + 1 + length(p.piece) END
        FROM packed k JOIN pieces p ON p.section_id = k.section_id AND p.run = k.run AND p.i = k.i + 1
    ),
    turns AS (
        SELECT *, page IS DISTINCT FROM lag(page) OVER (PARTITION BY section_id, run, number ORDER BY i)
            OR i = min(i) OVER (PARTITION BY section_id, run, number) AS turn FROM packed
    ),
    filled AS (
        SELECT section_id, run, number, string_agg(piece, chr(10) ORDER BY i) AS body,
            coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY i) FILTER (turn), '') AS pages
        FROM turns GROUP BY ALL
    ),
    chunked AS (
        SELECT n.path || '#' || (row_number() OVER (PARTITION BY f.section_id ORDER BY f.run, f.number) - 1) AS chunk_id, f.section_id,
            concat_ws(' › ', coalesce(n.title, ''), t.trail) AS title, pages, body
        FROM filled f LEFT JOIN trails t USING (section_id, run)
        JOIN (SELECT DISTINCT section_id, title, path FROM sections WHERE section_id IS NOT NULL AND path IS NOT NULL) n USING (section_id)
    )
"""
# Nodes of the logged records in document order, JSON text in strings opened, too; labels follow from order and depth.
_NODES = r"""
    WITH RECURSIVE l AS (
        SELECT line_id, any_value(trace_id) AS trace_id, regexp_extract(any_value(record), '(?s)^[\s\x{FEFF}]*(?:\[[A-Za-z_-]+\][\s\x{FEFF}]*)?(\{.*)$', 1) AS r
        FROM ask_log WHERE line_id IS NOT NULL AND trace_id IS NOT NULL AND record IS NOT NULL GROUP BY line_id
    ),
    t AS (
        SELECT line_id, trace_id, j.id AS o, j.parent AS po, j.key, j.type, j.value, j.value ->> '$' AS s
        FROM (SELECT * FROM l WHERE r <> '' AND json_valid(r)) v, json_tree(v.r) j
    ),
    x AS (SELECT *, type = 'VARCHAR' AND regexp_matches(s, '(?s)^[\[{].*[\]}]$') AND json_valid(s) AS inner_json FROM t),
    a AS (
        SELECT line_id, trace_id, CAST(o AS BIGINT) AS o, CAST(0 AS BIGINT) AS n, CAST(po AS BIGINT) AS po, CAST(0 AS BIGINT) AS pn, CAST(key AS VARCHAR) AS key, type, s
        FROM x WHERE NOT inner_json
        UNION ALL
        SELECT x.line_id, x.trace_id, x.o, j.id, CASE WHEN j.parent IS NULL THEN x.po ELSE x.o END, coalesce(j.parent, 0),
            CASE WHEN j.parent IS NULL THEN CAST(x.key AS VARCHAR) ELSE CAST(j.key AS VARCHAR) END, j.type, j.value ->> '$'
        FROM x, json_tree(CASE WHEN x.inner_json THEN x.s ELSE '{}' END) j WHERE x.inner_json
    ),
    w AS (
        SELECT line_id, trace_id, o, n, po, pn, 'record' AS name, CAST(NULL AS INTEGER) AS position, 0 AS depth, type, s FROM a WHERE po IS NULL
        UNION ALL
        SELECT c.line_id, c.trace_id, c.o, c.n, c.po, c.pn, CASE WHEN w.type = 'ARRAY' THEN w.name ELSE c.key END,
            CASE WHEN w.type = 'ARRAY' THEN CAST(c.key AS INTEGER) END, w.depth + 1, c.type, c.s
        FROM w JOIN a c ON c.line_id = w.line_id AND c.po = w.o AND c.pn = w.n
    ),
    i AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY o, n) - 1 AS i, count(*) OVER (PARTITION BY line_id) AS total FROM w),
    e AS (
        SELECT b.line_id, b.i, coalesce(min(c.i), b.total) - b.i AS size
        FROM i b LEFT JOIN i c ON c.line_id = b.line_id AND c.i > b.i AND c.depth <= b.depth GROUP BY b.line_id, b.i, b.total
    ),
    nodes AS (
        SELECT i.line_id, i.trace_id, CAST(2 * i.i - i.depth AS INTEGER) AS pre, CAST(2 * i.i - i.depth + 2 * size - 1 AS INTEGER) AS post,
            CAST(coalesce(2 * p.i - p.depth, -1) AS INTEGER) AS parent, i.depth, i.name, i.position,
            CASE i.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
            CASE WHEN i.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN i.s END AS value
        FROM i JOIN e USING (line_id, i) LEFT JOIN i p ON p.line_id = i.line_id AND p.o = i.po AND p.n = i.pn
    )
"""
_WITHIN = lambda n, name, kinds: (
    f"EXISTS (SELECT 1 FROM nodes c WHERE c.line_id = {n}.line_id AND c.name = '{name}' AND c.kind IN {kinds} AND c.pre < {n}.pre AND {n}.post < c.post)"
)
_STEPS = "('rewrite', 'search', 'answer', 'research', 'reanswer', 'total')"
_CHILDREN = f"""
    {_NODES},
    lists AS (SELECT line_id, pre, name FROM nodes n WHERE name IN ('queries', 'rounds') AND kind = 'array' AND {_WITHIN("n", "research", "('object')")}),
    query_rows AS (
        SELECT n.trace_id, row_number() OVER (PARTITION BY n.line_id ORDER BY n.pre) - 1 AS ord, coalesce(t.value, n.value) AS item
        FROM nodes n JOIN lists l ON l.line_id = n.line_id AND l.pre = n.parent
        LEFT JOIN nodes t ON t.line_id = n.line_id AND t.parent = n.pre AND t.position IS NULL AND t.kind IN ('string', 'number') AND t.name IN ('text', 'query')
        WHERE n.position IS NOT NULL AND (n.kind = 'object' OR l.name = 'queries')
    ),
    added_in AS (SELECT line_id, pre, post FROM nodes n WHERE name = 'added' AND kind IN ('object', 'array') AND {_WITHIN("n", "research", "('object')")}),
    added_rows AS (
        SELECT n.trace_id, row_number() OVER (PARTITION BY n.line_id ORDER BY n.pre) - 1 AS ord, coalesce(t.value, n.value) AS item
        FROM nodes n LEFT JOIN nodes t ON t.line_id = n.line_id AND t.parent = n.pre AND t.position IS NULL
            AND t.kind IN ('string', 'number') AND t.name IN ('id', 'chunk_id', 'chunk')
        WHERE n.position IS NOT NULL AND n.kind IN ('string', 'object', 'null')
            AND EXISTS (SELECT 1 FROM added_in c WHERE c.line_id = n.line_id AND c.pre < n.pre AND n.post < c.post)
    ),
    times AS (SELECT * FROM nodes n WHERE kind IN ('string', 'number') AND {_WITHIN("n", "ms", "('object')")}),
    step_rows AS (
        SELECT trace_id, name AS item, value FROM times WHERE name IN {_STEPS}
        UNION ALL
        SELECT t.trace_id, o.name, t.value FROM times t JOIN nodes o ON o.line_id = t.line_id AND o.pre = t.parent WHERE t.name = 'value' AND o.name IN {_STEPS}
        UNION ALL
        SELECT t.trace_id, o.value, t.value FROM times t JOIN times o ON o.line_id = t.line_id AND o.parent = t.parent
        WHERE t.name IN ('took', 'ms', 'value') AND o.name = 'name' AND o.value IN {_STEPS}
    ),
    step_times AS (
        SELECT trace_id, CAST(0 AS INTEGER) AS ord, item, max(TRY_CAST(regexp_extract(value, '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*(?:ms)?\\s*$', 1) AS DOUBLE)) AS ms
        FROM step_rows WHERE length(trim(value)) > 0 GROUP BY trace_id, item
    ),
    call_spans AS (
        SELECT line_id, pre, post, row_number() OVER (PARTITION BY line_id ORDER BY pre) - 1 AS ord FROM nodes n
        WHERE position IS NOT NULL AND kind = 'object' AND {_WITHIN("n", "usage", "('object', 'array')")}
    ),
    calls AS (
        SELECT n.trace_id, CAST(coalesce(c.ord, 0) AS INTEGER) AS ord, n.name AS item, max(CAST(n.value AS BIGINT)) AS tokens
        FROM nodes n LEFT JOIN call_spans c ON c.line_id = n.line_id
        WHERE n.name IN ('input', 'output') AND n.kind IN ('string', 'number') AND n.position IS NULL AND length(trim(n.value)) > 0
            AND {_WITHIN("n", "usage", "('object', 'array')")} AND (c.pre IS NULL OR (c.pre < n.pre AND n.post < c.post))
        GROUP BY ALL
    )
"""
_FIELDS = "question searchedFor status notCoveredReason errorCode citations droppedCitations uncitedChars model".split()
_OPENING = rf"regexp_extract(first.text, '(?s)^(.*?(?:[.!?:](?:[{SPACE}]|$)|\n))', 1)"

SQL: dict[str, str] = {
    "p5_nodes": f"{_NODES} SELECT * FROM nodes",
    "p5_found": f"""
        {_CHILDREN}
        SELECT DISTINCT trace_id, 'research.queries' AS child, CAST(ord AS INTEGER) AS ord, item FROM query_rows WHERE length(trim(item)) > 0
        UNION ALL SELECT DISTINCT trace_id, 'research.added', CAST(ord AS INTEGER), item FROM added_rows WHERE length(trim(item)) > 0
        UNION ALL SELECT trace_id, 'ms', ord, item FROM step_times
        UNION ALL SELECT trace_id, 'usage', ord, item FROM calls
    """,
    "p5_step_times": f"{_CHILDREN} SELECT trace_id, ord, item, ms FROM step_times",
    "p5_calls": f"{_CHILDREN} SELECT trace_id, ord, item, tokens FROM calls",
    "p5_traces": f"""
        {_NODES},
        owners AS (SELECT DISTINCT line_id, parent FROM nodes WHERE name IN ('ms', 'usage', 'question') AND depth > 0 AND parent >= 0),
        fields AS (
            SELECT trace_id, {", ".join(f'max(CASE WHEN name = {chr(39)}{f}{chr(39)} THEN value END) AS "{f}"' for f in _FIELDS)}
            FROM nodes SEMI JOIN owners USING (line_id, parent) WHERE kind IN ('string', 'number') AND position IS NULL GROUP BY trace_id
        )
        SELECT r.*, fields.* EXCLUDE (trace_id)
        FROM (SELECT trace_id, min(line_id) AS first_line, count(DISTINCT line_id) AS lines FROM nodes WHERE depth = 0 GROUP BY trace_id) r
        LEFT JOIN fields USING (trace_id)
    """,
    "trace_costs": f"""
        {_CHILDREN}
        SELECT trace_id, CAST(sum(tokens) AS BIGINT) AS tokens,
            round(sum(tokens * CASE item WHEN 'input' THEN {DOLLARS_PER_MILLION["input"]} ELSE {DOLLARS_PER_MILLION["output"]} END / 1e6), 6) AS dollars
        FROM calls GROUP BY trace_id
    """,
    "research_checks": f"""
        {_NODES},
        held AS (
            SELECT n.trace_id, n.name, coalesce(t.value, n.value) AS item FROM nodes n
            JOIN nodes r ON r.line_id = n.line_id AND r.pre = n.parent AND r.name = 'research' AND r.kind = 'object'
            LEFT JOIN nodes t ON t.line_id = n.line_id AND t.parent = n.pre AND t.name = 'status' AND t.kind = 'string' WHERE n.name IN ('first', 'outcome')
        ),
        research AS (
            SELECT trace_id, max(CASE WHEN name = 'first' THEN item END) AS first, max(CASE WHEN name = 'outcome' THEN item END) AS outcome FROM held GROUP BY trace_id
        ),
        counted AS (
            SELECT count_if(status = 'not-covered') AS declined, count_if(status = 'not-covered' AND research.outcome <> 'failed') AS again,
                count_if(first = 'not-covered') AS lost, count_if(first = 'not-covered' AND status = 'answered') AS won
            FROM ({_ANSWERS}) LEFT JOIN research USING (trace_id)
        )
        SELECT CASE WHEN declined = 0 THEN 'n/a' ELSE again || '/' || declined END AS not_covered_searched_again,
            CASE WHEN lost = 0 THEN 'n/a' ELSE won || '/' || lost END AS not_found_then_answered FROM counted
    """,
    "grade_answers": f"SELECT row_id, id, outcome, grade FROM ({_GRADED})",
    "outcome_counts": f"""
        SELECT kind, count(*) AS answers, count_if(grade = 'pass') AS passed, count_if(grade = 'review') AS for_review,
            count_if(grade = 'fail') AS failed, count_if(grade IS NOT DISTINCT FROM outcome) AS as_saved
        FROM ({_GRADED}) GROUP BY kind
    """,
    "reading_checks": rf"""
        WITH a AS (
            SELECT parts, list_filter(parts, lambda p: {_TRIM("p.text")} <> '')[1] AS first
            FROM ({_ANSWERS}) WHERE status = 'answered' AND len(parts) > 0
        )
        SELECT count(*) AS answered,
            count_if({_OPENING} <> '' AND coalesce(len(first.citations), 0) = 0 AND {_IS_CLAIM(_OPENING)}) AS opens_uncited,
            count_if(len(list_filter(parts, lambda p: coalesce(len(p.citations), 0) = 0
                AND regexp_matches(p.text, '(?i)\b(?:passages?|excerpts?)\b'))) > 0) AS about_passages
        FROM a
    """,
    "rendered_blocks": rf"""
        SELECT section_id, block_ord, CASE
            WHEN coalesce(list_level, 0) <= 0 THEN text
            WHEN coalesce(continued, FALSE) THEN repeat('  ', list_level) || text
            WHEN regexp_matches(text, '^\d+[.)][{SPACE}]') THEN repeat('  ', list_level - 1) || text
            ELSE repeat('  ', list_level - 1) || '- ' || text END AS line
        FROM ({_BLOCKS}) WHERE kind = 'paragraph' AND text IS NOT NULL
    """,
    "heading_trail": f"""
        WITH b AS (
            SELECT section_id, block_ord, level, kind = 'heading' AS h, coalesce(text, '') AS t FROM ({_BLOCKS})
        ),
        w AS (
            SELECT section_id, block_ord,
                max(CASE WHEN h THEN block_ord END) OVER r AS pos,
                max(CASE WHEN h AND level = 1 THEN block_ord END) OVER r AS pos1,
                max(CASE WHEN h AND level = 2 THEN block_ord END) OVER r AS pos2
            FROM b WINDOW r AS (PARTITION BY section_id ORDER BY block_ord)
        )
        SELECT w.section_id, w.block_ord, coalesce(pos, -1) AS run, CASE
            WHEN pos IS NULL THEN '' WHEN x.level = 1 THEN x.t
            WHEN x.level = 2 THEN concat_ws(' › ', b1.t, x.t)
            ELSE concat_ws(' › ', b1.t, CASE WHEN pos1 IS NULL OR pos2 > pos1 THEN b2.t END, x.t) END AS trail
        FROM w LEFT JOIN b x ON x.section_id = w.section_id AND x.block_ord = pos
        LEFT JOIN b b1 ON b1.section_id = w.section_id AND b1.block_ord = pos1
        LEFT JOIN b b2 ON b2.section_id = w.section_id AND b2.block_ord = pos2
    """,
    "long_text_split": rf"""
        WITH RECURSIVE s AS (
            SELECT section_id, block_ord, -1 AS piece_ord, CAST(NULL AS VARCHAR) AS piece, text AS rest
            FROM ({_BLOCKS}) WHERE length(text) > 1000
            UNION ALL
            SELECT section_id, block_ord, piece_ord + 1,
                CASE WHEN cut IS NULL THEN rest ELSE regexp_replace(substr(rest, 1, cut), '[{SPACE}]+$', '') END,
                CASE WHEN cut IS NULL THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^[{SPACE}]+', '') END
            FROM (
                SELECT *, CASE WHEN length(rest) <= 1000 THEN NULL
                    WHEN length(regexp_extract(substr(rest, 1, 1001), '(?s)^(.+[.!?]) ', 1)) > 0
                        THEN length(regexp_extract(substr(rest, 1, 1001), '(?s)^(.+[.!?]) ', 1))
                    WHEN length(regexp_extract(substr(rest, 1, 1001), '(?s)^(.+) ', 1)) > 0
                        THEN length(regexp_extract(substr(rest, 1, 1001), '(?s)^(.+) ', 1))
                    ELSE 1000 END AS cut
                FROM s WHERE rest <> ''
            )
        )
        SELECT section_id, block_ord, CAST(piece_ord AS INTEGER) AS piece_ord, piece FROM s WHERE piece_ord >= 0
    """,
    "chunk_stats": f"""
        WITH l AS (
            SELECT list_sort(list(length({_BODY}))) AS s, count_if(len(pages) > 1) AS many FROM ({_CHUNKS})
        )
        SELECT CAST(len(s) AS BIGINT) AS chunks, s[1] AS shortest, s[least(len(s) - 1, CAST(floor(len(s) * 0.5) AS BIGINT)) + 1] AS median,
            s[least(len(s) - 1, CAST(floor(len(s) * 0.9) AS BIGINT)) + 1] AS p90, s[len(s)] AS longest, many AS many_pages FROM l
    """,
    "body_text": f"""
        SELECT chunk_id, {_BODY} AS body, sha256(coalesce(title, '') || chr(10) || chr(10) || {_BODY}) AS search_sha256 FROM ({_CHUNKS})
    """,
    "tokenize_passages": f"""
        SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest({_TERMS("body")}) AS term FROM ({_PASSAGES})) GROUP BY ALL
    """,
    "doc_frequency": f"""
        SELECT term, count(*) AS passages FROM (
            SELECT DISTINCT chunk_id, unnest({_TERMS("title || ' ' || body")}) AS term FROM ({_PASSAGES})
        ) GROUP BY term
    """,
    "rare_words": f"WITH {_rare(_QUESTIONS)} SELECT * FROM rare",
    "rare_word_match": f"""
        WITH {_rare(_QUESTIONS)}, {_bm25("SELECT id, term FROM rare")}
        SELECT id, chunk_id, score FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) = 1
    """,
    "bm25_topk": f"WITH {_bm25(_QUESTION_TERMS)} {_TOP12}",
    "semantic_topk": f"WITH {_ranked()} SELECT query_ord, rank, chunk_ord, similarity FROM r0",
    "vector_products": f"""
        SELECT chunk_ord, round(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b), 6) AS squared FROM ({_VECTORS})
    """,
    "hybrid_search": f"""
        WITH {_ranked()},
        {_rare(f"SELECT CAST(chunk_ord AS VARCHAR) AS id, title AS question FROM ({_CHUNKS}) WHERE chunk_ord % 50 = 0")},
        {_bm25("SELECT id, term FROM rare")},
        matched AS (
            SELECT CAST(id AS INTEGER) AS query, chunk_id FROM scores
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) = 1
        ),
        fresh AS (
            SELECT m.query, least(12, s.size + 1) AS rank, m.chunk_id, (
                SELECT round(list_cosine_similarity(q.e, x.e), 6) FROM v0 q, v0 x JOIN c0 c ON c.chunk_ord = x.chunk_ord
                WHERE q.chunk_ord = m.query AND c.chunk_id = m.chunk_id
            ) AS similarity FROM matched m
            JOIN (SELECT query, max(rank) AS size FROM ranked GROUP BY query) s USING (query)
            ANTI JOIN ranked r ON r.query = m.query AND r.chunk_id = m.chunk_id
        )
        SELECT query, rank, chunk_id, similarity, 'semantic' AS via FROM ranked r
        ANTI JOIN fresh f ON f.query = r.query AND f.rank = r.rank
        UNION ALL SELECT query, CAST(rank AS INTEGER), chunk_id, similarity, 'keyword' FROM fresh
    """,
    "closest_sections": f"""
        WITH {_ranked()},
        f AS (
            SELECT query, section_path, rank, title, pages[1].page AS page FROM ranked JOIN ({_CHUNKS}) USING (chunk_id)
            QUALIFY row_number() OVER (PARTITION BY query, section_path ORDER BY rank) = 1
        )
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS position, section_path, title, page
        FROM f QUALIFY position <= 3
    """,
    "round_robin_research": f"{_RESEARCHED} SELECT query, position, chunk_id FROM added",
    "second_passages": f"{_RESEARCHED} SELECT query, rank, chunk_id FROM second",
    "closest_after_research": f"""
        {_RESEARCHED},
        f AS (
            SELECT query, section_path, list, rank, title, pages[1].page AS page FROM (
                SELECT query, 1 AS list, rank, chunk_id FROM ranked UNION ALL SELECT query, 0, position, chunk_id FROM added
            ) JOIN ({_CHUNKS}) USING (chunk_id)
            QUALIFY row_number() OVER (PARTITION BY query, section_path ORDER BY list, rank) = 1
        )
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY list, rank) AS INTEGER) AS position, section_path, title, page
        FROM f QUALIFY position <= 3
    """,
    "cited_added": f"""
        {_RESEARCHED},
        each AS (
            SELECT row_id, unnest(CASE WHEN len(numbers) > 0 THEN numbers ELSE [NULL] END) AS number,
                (row_id % (SELECT (count(*) + 49) // 50 FROM ({_CHUNKS}))) * 50 AS query
            FROM (SELECT row_id, flatten(list_transform(parts, lambda p: coalesce(p.citations, []))) AS numbers FROM ({_ANSWERS}))
        ),
        dealt AS (
            SELECT row_id, query, (row_id * 5 + number - 1) % size + 1 AS rank FROM each
            JOIN (SELECT query, max(rank) AS size FROM second GROUP BY query) USING (query)
        ),
        citing AS (SELECT DISTINCT row_id FROM dealt JOIN second USING (query, rank) SEMI JOIN added USING (query, chunk_id))
        SELECT row_id, c.row_id IS NOT NULL AS cites_added FROM (SELECT DISTINCT row_id FROM each) LEFT JOIN citing c USING (row_id)
    """,
    "search_eval": f"{_SEARCHED} SELECT id, ranked_rank, search_rank, keyword_net, section_hit FROM searched",
    "search_summary": f"""
        {_SEARCHED}
        SELECT count(*) AS questions, count(ranked_rank) AS ranked_hits, count(search_rank) AS search_hits,
            count_if(section_hit) AS section_hits, count(keyword_net) AS net_used,
            count_if(keyword_net = 'added the answer') AS net_added_answer,
            count_if(ranked_rank IS NOT NULL AND search_rank IS NULL) AS net_pushed_out
        FROM searched
    """,
    "section_pages": """
        SELECT section_id, min(page) AS start_page, max(page) AS end_page FROM blocks WHERE section_id IS NOT NULL GROUP BY section_id
    """,
    "index_roundtrip": f"""
        SELECT chunk_ord, chunk_id, CAST(len(e) AS INTEGER) AS dim,
            round(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b), 6) AS squared
        FROM ({_CHUNKS}) JOIN ({_VECTORS}) USING (chunk_ord)
    """,
    "citable_blocks": f"""
        SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY p, l) - 1 AS INTEGER) AS block_index, page, text FROM (
            SELECT chunk_id, p, page, unnest(range(len(lines))) AS l, unnest(lines) AS text FROM (
                SELECT chunk_id, p, pages[p].page AS page, string_split(pages[p].text, chr(10)) AS lines
                FROM (SELECT chunk_id, pages, unnest(range(1, len(pages) + 1)) AS p FROM ({_CHUNKS}))
                WHERE pages[p].text IS NOT NULL
            )
        )
    """,
    "gap_lines": rf"""
        WITH g AS (
            SELECT row_id, list_filter(list_transform(
                regexp_extract_all(array_to_string(list_concat([coalesce(answer, '')], list_transform(coalesce(gaps, []), lambda g: '- **GAP:** ' || g)), chr(10)),
                    '(?im)^[ \t]*(?:[-*•][ \t]+|\d+[.)][ \t]+)?(?:\*\*)?GAP(?:\*\*)?[ \t]*:(?:\*\*)?[ \t]*(.*?)[ \t]*(?:\r?\n|$)', 1),
                lambda x: {_TRIM('''regexp_replace(x, '^["''“*]+|["''”*]+$', '', 'g')''')}), lambda x: x <> '') AS found FROM ({_ANSWERS})
        )
        SELECT row_id, CAST(unnest(range(len(found))) AS INTEGER) AS gap_ord, unnest(found) AS gap FROM g
    """,
    "dedupe_gaps": f"""
        WITH g AS (
            SELECT row_id, list_reduce(list_filter(gaps, lambda x: x IS NOT NULL), lambda kept, gap:
                CASE WHEN len(list_filter(kept, lambda k: len(list_filter({_WORDS("gap[1]")}, lambda w: NOT list_contains({_WORDS("k")}, w))) = 0
                    OR len(list_filter({_WORDS("k")}, lambda w: NOT list_contains({_WORDS("gap[1]")}, w))) = 0)) > 0
                THEN kept ELSE list_append(kept, gap[1]) END, CAST([] AS VARCHAR[])) AS kept
            FROM (SELECT row_id, list_transform(gaps, lambda x: [x]) AS gaps FROM ({_ANSWERS}) WHERE len(gaps) > 0)
        )
        SELECT row_id, CAST(unnest(range(len(kept))) AS INTEGER) AS gap_ord, unnest(kept) AS gap FROM g
    """,
    "searchable_gaps": f"""
        WITH firsts AS (
            SELECT row_id, gap, min(i) AS i FROM (
                SELECT row_id, unnest(gaps) AS gap, unnest(range(len(gaps))) AS i FROM ({_ANSWERS})
            ) GROUP BY row_id, gap
        )
        SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS INTEGER) AS gap_ord, gap
        FROM firsts WHERE len({_WORDS("gap")}) >= 2 QUALIFY gap_ord < 3
    """,
    "uncited_claims": f"""
        SELECT row_id, part_ord, text FROM ({_PARTS}) WHERE coalesce(len(citations), 0) = 0 AND {_IS_CLAIM("text")}
    """,
    "passage_remarks": rf"""
        WITH p AS (
            SELECT row_id, string_split(regexp_replace('The passages don''t say more. They only mention it. ' || answer || chr(10) || 'These excerpts stop here.',
                '([.!?][{SPACE}]+|\n+)', '\1' || chr(1), 'g'), chr(1)) AS pieces
            FROM ({_ANSWERS}) WHERE answer IS NOT NULL
        ),
        d AS (
            SELECT row_id, list_reduce(list_transform(pieces, lambda x: {{'text': x, 'dropped': 0, 'after': FALSE}}), lambda s, x: CASE
                WHEN regexp_matches({_TRIM("x.text")}, '[.!?]$') AND (
                    regexp_matches({_TRIM("x.text")}, '(?i)^(?:the|these|those)[{SPACE}]+(?:passages?|excerpts?)(?:[^A-Za-z0-9_]|$)')
                    OR (s.after AND regexp_matches({_TRIM("x.text")}, '(?i)^(?:they|these|those)(?:[^A-Za-z0-9_]|$)')))
                THEN {{'text': s.text || regexp_extract(x.text, '^[{SPACE}]*'), 'dropped': s.dropped + 1, 'after': TRUE}}
                ELSE {{'text': s.text || x.text, 'dropped': s.dropped, 'after': s.after AND {_TRIM("x.text")} = ''}} END,
                {{'text': '', 'dropped': 0, 'after': FALSE}}) AS s FROM p
        )
        SELECT row_id, s.text AS text, s.dropped AS dropped FROM d
    """,
    "restatements": rf"""
        WITH b AS (
            SELECT row_id, part_ord, text, regexp_replace(text, '[{SPACE}]+$', '') AS body FROM ({_PARTS})
            WHERE len(citations) > 0 AND NOT regexp_matches(text, '\n[{SPACE}]*$') AND regexp_matches(text, '[.!?][{SPACE}]*$')
        ),
        c AS (
            SELECT *, list_reduce(list_transform(
                string_split(regexp_replace(left(body, -1), '([.!?][{SPACE}]+|\n+)', '\1' || chr(1), 'g'), chr(1))[1:-2],
                lambda x: {{'piece': x, 'at': 0, 'start': 0}}), lambda s, x: {{
                    'piece': '', 'at': s.at + CAST(length(x.piece) AS INTEGER),
                    'start': CASE WHEN regexp_matches(x.piece, '(?i)(?:^|[^A-Za-z0-9_])(?:e\.g|i\.e|etc|vs|approx|U\.S|U\.K)\.[{SPACE}]+$')
                        THEN s.start ELSE s.at + CAST(length(x.piece) AS INTEGER) END }},
                {{'piece': '', 'at': 0, 'start': 0}}).start AS cut
            FROM b
        ),
        l AS (
            SELECT *, cut + CAST(length(regexp_extract(substr(body, cut + 1), '^[{SPACE}]*(?:[-*•][ \t]+|\d+[.)][ \t]+)?')) AS INTEGER) AS start FROM c
        )
        SELECT row_id, part_ord, start, left(text, start) AS kept FROM l WHERE len(list_distinct({_WORDS("substr(body, start + 1)")})) >= 4
    """,
    "answer_texts": rf"""
        SELECT row_id,
            array_to_string(list_transform(parts, lambda p: coalesce(p.text, '') || array_to_string(list_transform(coalesce(p.citations, []), lambda n: '[' || n || ']'), '')), '') AS text,
            CAST(coalesce(list_sum(list_transform(list_filter(parts, lambda p: coalesce(len(p.citations), 0) = 0), lambda p: length(regexp_replace(coalesce(p.text, ''), '[^\p{{L}}\p{{N}}]', '', 'g')))), 0) AS INTEGER) AS uncited,
            coalesce((SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) FROM (
                SELECT n, min(i) AS i FROM (SELECT unnest(l) AS n, unnest(range(len(l))) AS i FROM (SELECT flatten(list_transform(parts, lambda p: coalesce(p.citations, []))) AS l)) GROUP BY n
            )), '') AS cited
        FROM ({_ANSWERS}) WHERE len(parts) > 0
    """,
    "gate_verdict": rf"""
        WITH a AS (
            SELECT row_id, {_TRIM("coalesce(answer, '')")} AS t, coalesce(len(gaps), 0) AS gaps,
                coalesce(len(flatten(list_transform(parts, lambda p: coalesce(p.citations, [])))), 0) AS cited
            FROM ({_ANSWERS})
        )
        SELECT row_id, CASE
            WHEN starts_with(t, 'NOT_COVERED') OR (cited = 0 AND regexp_matches(t, '(?m)^[ \t]*NOT_COVERED(?:[^A-Za-z0-9_]|$)')) THEN 'model-said-not-covered'
            WHEN t = '' AND gaps > 0 THEN 'only-gaps' WHEN t = '' THEN 'model-said-not-covered'
            WHEN cited = 0 THEN 'no-citations' ELSE 'answered' END AS verdict
        FROM a
    """,
    "resolve_citations": f"{_RESOLVED} SELECT row_id, part, position, n, chunk_id, pages, quote FROM resolved",
    "citation_cards": rf"""
        {_RESOLVED}
        SELECT row_id, part, position, n, CASE WHEN contains(pages, ',') THEN 'pp. ' ELSE 'p. ' END || replace(pages, ',', '–') AS label,
            regexp_replace(quote, '^[{SPACE}]*- ', '') AS preview
        FROM resolved
    """,
    "question_sets_roundtrip": f"""
        SELECT id, question, CASE WHEN NOT coalesce(out_of_scope, FALSE) THEN array_to_string(expect, '|') END AS expect,
            coalesce(out_of_scope, FALSE) AS out_of_scope, answer, evidence, pool, style FROM ({_QUESTIONS})
    """,
    "results_roundtrip": f"SELECT row_id, id, outcome, grade FROM ({_GRADED})",
    "chunk_sections": f"""
        {_CHUNKED} SELECT chunk_id, section_id, title, pages, body FROM chunked
    """,
    "ingest_terms": f"""
        {_CHUNKED}
        SELECT term, count(*) AS passages FROM (
            SELECT DISTINCT chunk_id, unnest({_TERMS("title || ' ' || body")}) AS term FROM chunked
        ) GROUP BY term
    """,
    "evidence_chunks": _EVIDENCE,
    "missing_expectations": f"""
        SELECT DISTINCT id, section FROM (SELECT id, unnest(expect) AS section FROM ({_QUESTIONS})) q
        WHERE section IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM chunks c WHERE {_SHORT("c.section_path")} = {_SHORT("q.section")}
        )
    """,
    "retrieval_eval": f"{_EVALUATED} SELECT id, search_rank FROM evaluated",
    "retrieval_summary": f"""
        {_EVALUATED}
        SELECT count(*) AS questions, count(search_rank) AS hits, count_if(search_rank <= 8) AS hits_at_8,
            round(coalesce(avg(coalesce(1 / search_rank, 0.0)), 0.0), 6) AS mrr
        FROM evaluated
    """,
    "unknown_answers": f"""
        SELECT row_id, id FROM ({_ANSWERS}) a WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.id = a.id)
    """,
    "answer_length_medians": f"""
        SELECT kind, CAST(len(s) AS BIGINT) AS n, s[CAST(floor(len(s) / 2) AS BIGINT) + 1] AS median
        FROM (SELECT kind, list_sort(list(length(answer))) AS s FROM ({_ANSWERS}) WHERE answer IS NOT NULL GROUP BY kind)
    """,
    "line_texts": f"""
        {_LINES} SELECT doc_id, page, line_ord, y, x, "right", size, text FROM lines
    """,
    "line_geometry": f"""
        {_LINES} SELECT doc_id, page, line_ord, y, x, "right", size FROM lines
    """,
    "indent_margins": rf"""
        {_LINES},
        page AS (SELECT doc_id, max("right") AS page_margin FROM lines GROUP BY doc_id),
        counted AS (
            SELECT doc_id, CAST(floor(x + 0.5) AS INTEGER) AS indent, list_sort(list("right")) AS s
            FROM lines WHERE NOT regexp_matches(text, '^\d+[.)][{SPACE}]') GROUP BY ALL
        ),
        measured AS (
            SELECT doc_id, indent, CAST(len(s) AS BIGINT) AS lines, s[CAST(floor((len(s) - 1) * 0.99) AS BIGINT) + 1] AS margin, page_margin
            FROM counted JOIN page USING (doc_id)
        )
        SELECT *, lines >= 20 AND margin <= page_margin - 10 AS is_narrower FROM measured
    """,
}
