"""The queries of queries.py in DuckDB's SQL."""

from __future__ import annotations

from doclens.functions import text as t
from doclens.operators import chunks, lexicon, rules
from doclens.plans import queries as q

WS, DIGIT = t.WS, t.DIGIT
L = lexicon.WORD_CLASS
MARK = "chr(57344)"
NL = "chr(10)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def norm(x: str) -> str:
    return squash(f"translate(nfc_normalize({x}), '’‘‚ʼ“”„', '''''''''\"\"\"')")


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tr_lower(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def tr_upper(x: str) -> str:
    return f"replace(replace(upper(translate({x}, 'ıi', 'Iİ')), 'ß', 'SS'), 'ẞ', 'SS')"


def upper(x: str) -> str:
    return f"replace(replace(upper({x}), 'ß', 'SS'), 'ẞ', 'SS')"


def tr_capitalize(x: str) -> str:
    return f"({tr_upper(f'substring({x}, 1, 1)')} || substring({x}, 2))"


def match_case(ref: str, x: str) -> str:
    return (
        f"CASE WHEN length({ref}) = 0 OR length({x}) = 0 THEN {x} WHEN {ref} = {upper(ref)} AND {ref} <> lower({ref}) AND length({ref}) > 1 THEN {tr_upper(x)} "
        rf"WHEN regexp_matches(substring({ref}, 1, 1), '\p{{Lu}}') AND regexp_matches(substring({x}, 1, 1), '\p{{Ll}}') THEN {tr_capitalize(x)} ELSE {x} END"
    )


def clean(x: str) -> str:
    body = f"regexp_replace({strip(x)}, {quoted(t.ANCHOR)}, '\\1', 'g')"
    body = f"regexp_replace({body}, {quoted(t.URL)}, '{t.LINK}', 'g')"
    body = f"regexp_replace({body}, {quoted(t.IMAGE_INLINE)}, ' {t.IMAGE} ', 'g')"
    return f"CASE WHEN regexp_matches({strip(x)}, {quoted(t.IMAGE_LINE)}) THEN '' ELSE {strip(f"regexp_replace({body}, '[ \t]{{2,}}', ' ', 'g')")} END"


def kind(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {quoted(t.TOC)}) THEN 'icindekiler' "
        f"WHEN length({x}) <= 40 AND regexp_matches({x}, '[{t.ANY_DIGIT}]') AND length(regexp_replace({x}, {quoted(t.RESIDUE)}, '', 'g')) <= 3 THEN 'tablo_hucresi' "
        rf"WHEN regexp_matches({x}, '\p{{L}}') AND length({x}) <= 100 AND {x} = {upper(x)} THEN 'baslik' ELSE 'paragraf' END"
    )


LINES = f"lines AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, {NL}) AS a FROM documents))"
RAW_BLOCKS = f"{LINES}, raw_blocks AS (SELECT doc_id, pos, text, {kind('text')} AS kind FROM (SELECT doc_id, pos, {clean('raw')} AS text FROM lines) WHERE text <> '')"
DEDUPED = f"{RAW_BLOCKS}, deduped AS (SELECT doc_id, pos, text, kind FROM (SELECT *, lag({squash('text')}) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM raw_blocks) WHERE {squash('text')} IS DISTINCT FROM before)"
PLACED = f'{DEDUPED}, placed AS MATERIALIZED (SELECT *, CAST(s AS INT) AS "start", CAST(s + length(text) AS INT) AS "end" FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM deduped))'
TEXTS = f"{PLACED}, texts AS (SELECT doc_id, string_agg(text, {NL} || {NL} ORDER BY pos) AS text FROM placed GROUP BY doc_id)"


def sentences(source: str, name: str) -> str:
    """Spans of the sentences of (doc_id, pos, text, start, end) in ``source``."""
    short = ", ".join(f"'{a}'" for a in chunks.ABBREVIATIONS.split())
    return rf"""
{name}_f AS (SELECT doc_id, pos, "start", unnest(range(len(a))) AS i, unnest(a) AS frag, len(a) AS n FROM (
  SELECT doc_id, pos, "start", string_split(regexp_replace(text, '([.!?])([{WS}]+)([A-ZÇĞİÖŞÜ])', '\1\2' || {MARK} || '\3', 'g'), {MARK}) AS a FROM {source})),
{name}_w AS (SELECT *, regexp_extract(frag, '([{t.WORD}]+)[.!?]+[{WS}]+\z', 1) AS w FROM {name}_f),
{name}_g AS (SELECT *, coalesce(lag(CASE WHEN w = '' OR lower(w) IN ({short}) OR regexp_full_match(w, '{DIGIT}+') OR length(w) = 1 THEN 0 ELSE 1 END) OVER o, 0) AS new,
  coalesce(sum(length(frag)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {name}_w WINDOW o AS (PARTITION BY doc_id, pos ORDER BY i)),
{name}_h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, pos ORDER BY i) AS g FROM {name}_g),
{name} AS (SELECT doc_id, pos, g, CAST(min("start" + off) AS INT) AS s, CAST(max("start" + off + length(frag)) AS INT) AS e FROM {name}_h GROUP BY doc_id, pos, g)"""


def chunked(budget: int, name: str = "chunks") -> str:
    return f"""{TEXTS}, long_blocks AS (SELECT * FROM placed WHERE length(text) > {budget}), {sentences("long_blocks", "sent")},
spans AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM (
  SELECT doc_id, "start" AS s, "end" AS e FROM placed WHERE length(text) <= {budget} UNION ALL SELECT doc_id, s, e FROM sent)),
packed AS (SELECT doc_id, i, s, e, s AS c, 0 AS g FROM spans WHERE i = 1 UNION ALL
  SELECT n.doc_id, n.i, n.s, n.e, CASE WHEN n.e - p.c <= {budget} THEN p.c ELSE n.s END, CASE WHEN n.e - p.c <= {budget} THEN p.g ELSE p.g + 1 END
  FROM packed p JOIN spans n ON n.doc_id = p.doc_id AND n.i = p.i + 1),
{name} AS MATERIALIZED (SELECT k.*, substring(x.text, k."start" + 1, k."end" - k."start") AS text FROM (
  SELECT doc_id, g AS chunk_id, min(s) AS "start", max(e) AS "end" FROM packed GROUP BY doc_id, g) k JOIN texts x USING (doc_id))"""


CHUNKS = chunked(chunks.MAX_CHARS)


def tokens(source: str, name: str, keys: str) -> str:
    return f"""
{name}_p AS (SELECT {keys}, unnest(range(len(a))) AS k, unnest(a) AS piece FROM (SELECT {keys}, string_split(regexp_replace(text, '([{L}]+)', {MARK} || '\\1' || {MARK}, 'g'), {MARK}) AS a FROM {source})),
{name} AS MATERIALIZED (SELECT * FROM (SELECT {keys}, k, piece AS word, coalesce(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {name}_p) WHERE k % 2 = 1)"""


DOUBLED = ", ".join(map(quoted, rules.DOUBLED.split()))
REPEATS = f"""{CHUNKS}, {tokens("chunks", "tok", "doc_id, chunk_id")},
repeats AS (SELECT doc_id, chunk_id, word || ' ' || word AS excerpt, word AS suggestion, CAST(off AS INT) AS emit_idx FROM (
  SELECT *, lead(word) OVER o AS w2, lead(off) OVER o AS off2 FROM tok WINDOW o AS (PARTITION BY doc_id, chunk_id ORDER BY off)) WHERE word = w2 AND off2 = off + length(word) + 1 AND {tr_lower("word")} NOT IN ({DOUBLED}))"""
DOTS = f"""dots AS (SELECT doc_id, chunk_id, unnest(a) AS excerpt, unnest(range(len(a))) AS n FROM (SELECT doc_id, chunk_id, regexp_extract_all(text, '{DIGIT}+\\.{DIGIT}+') AS a FROM chunks))"""
LITERAL_TABLE = "lit(wrong, fix, kind, rule) AS (VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in rules.LITERALS) + ")"

WORDS = f"""{PLACED}, {tokens("placed", "tok", "doc_id, pos")}, fw AS MATERIALIZED (SELECT t.doc_id, t.pos, CAST(t.k // 2 AS INT) AS n, CAST(p."start" + t.off AS INT) AS "start", t.word AS w FROM tok t JOIN placed p ON p.doc_id = t.doc_id AND p.pos = t.pos)"""
SEEDS = f"""{WORDS}, seeds AS MATERIALIZED (
  SELECT doc_id, k.kind AS type, w AS excerpt, k.note AS explanation,
    CASE k.note WHEN 'r0' THEN '  ' || w || ' ' WHEN 'r1' THEN w || 'q' WHEN 'r2' THEN w || '.' WHEN 'r6' THEN reverse(w) ELSE {upper("w")} END AS suggestion,
    CASE WHEN k.note <> 'r6' THEN "start" END AS "start", CASE WHEN k.note <> 'r6' THEN CAST("start" + length(w) AS INT) END AS "end"
  FROM (SELECT *, unnest([n % 7, (n + 3) % 7]) AS i FROM fw) x
  JOIN (VALUES (0, 'imla', 'r0'), (1, 'dil_bilgisi', 'r1'), (2, 'ton', 'r2'), (3, 'dil_bilgisi', 'r3'), (4, 'ton', 'r4'), (5, 'tutarlilik', 'r5'), (6, 'imla', 'r6')) k(i, kind, note) ON k.i = x.i)"""
SLIM = 'doc_id, type, excerpt, suggestion, "start", "end"'
CORRUPT = "len(list_filter(string_split(suggestion, ''), lambda c: c IN ('q', 'w', 'x', 'Q', 'W', 'X', '`') AND NOT contains(excerpt, c))) > 0"


def prio(x: str) -> str:
    return f"CASE {x} WHEN 'imla' THEN 0 WHEN 'dil_bilgisi' THEN 1 WHEN 'ton' THEN 2 END"


def bare(x: str) -> str:
    return f"list_transform(string_split({norm(x)}, ' '), lambda w: regexp_replace(w, {quoted(t.TRAILING)}, ''))"


def cross_pass(source: str, name: str) -> str:
    """Findings of ``source`` without those that a stronger one covers."""
    return f"""
{name}_k AS (SELECT *, {prio("type")} AS prio, {norm("excerpt")} AS ne, {bare("excerpt")} AS ea, {bare("suggestion")} AS sa FROM {source}),
{name}_a AS (SELECT *, CASE WHEN len(ea) = len(sa) THEN list_filter(list_zip(ea, sa), lambda p: p[1] <> p[2]) END AS diff FROM {name}_k),
{name}_c AS MATERIALIZED (SELECT *, unnest(range("start" // 128, ("end" - 1) // 128 + 1)) AS cell FROM {name}_a WHERE prio IS NOT NULL AND "start" IS NOT NULL),
{name}_g AS (SELECT DISTINCT f.doc_id, f.type, f."start", f."end", f.excerpt, f.suggestion FROM {name}_c f JOIN {name}_c o ON o.doc_id = f.doc_id AND o.cell = f.cell AND f."start" < o."end" AND o."start" < f."end" AND o.prio < f.prio
  AND (o.ne = f.ne OR (len(o.diff) = 1 AND len(f.diff) = 1 AND o.diff = f.diff))),
{name} AS (SELECT a.* FROM {name}_a a ANTI JOIN {name}_g g ON g.doc_id = a.doc_id AND g.type = a.type AND g."start" = a."start" AND g."end" = a."end" AND g.excerpt = a.excerpt AND g.suggestion = a.suggestion)"""


AXES = "count(*) AS toplam, " + ", ".join(f"CAST(sum(CASE WHEN type = '{a}' THEN 1 ELSE 0 END) AS BIGINT) AS {a}" for a in ("imla", "dil_bilgisi", "ton", "tutarlilik"))


def summary(condition: str) -> str:
    return f"""dsum AS (SELECT doc_id, 'tutarlilik' AS type, arg_min(hit, s) AS excerpt,
  'Belge genelinde tablo değerlerinde ondalık ayraç olarak nokta kullanılmış (' || sum(n) || ' yerde); TDK''ya göre ondalık ayraç virgüldür. Tek tek işaretlemek yerine toplu bildirilmiştir.' AS explanation,
  replace(arg_min(hit, s), '.', ',') AS suggestion, CAST(min(s) AS INT) AS "start", CAST(min(s) + length(arg_min(hit, s)) AS INT) AS "end"
  FROM (SELECT doc_id, len(a) AS n, a[1] AS hit, "start" + strpos(text, a[1]) - 1 AS s FROM (SELECT *, regexp_extract_all(text, '{DIGIT}+\\.{DIGIT}+') AS a FROM placed WHERE {condition}) WHERE len(a) > 0)
  GROUP BY doc_id HAVING sum(n) >= 3)"""


PATTERNS = f"""
next2 AS (SELECT *, lead(word) OVER o AS w2, lead(off) OVER o AS off2 FROM tok WINDOW o AS (PARTITION BY doc_id, chunk_id ORDER BY off)),
beside AS (SELECT n.* FROM next2 n JOIN chunks c USING (doc_id, chunk_id) WHERE off2 = off + length(word) + 1 AND substring(c.text, CAST(off2 AS BIGINT), 1) = ' '),
phr(wrong, fix, kind, rule) AS (VALUES {", ".join(f"({', '.join(map(quoted, r))})" for r in rules.PHRASES)}),
unit(wrong, fix) AS (VALUES {", ".join(f"({', '.join(map(quoted, r))})" for r in rules.UNITS)}),
ords AS (SELECT doc_id, chunk_id, unnest(a) AS excerpt, unnest(range(len(a))) AS n FROM (SELECT doc_id, chunk_id, regexp_extract_all(text, {quoted(rules.ORDINAL)}, 1) AS a FROM chunks)),
ands AS (SELECT doc_id, chunk_id, unnest(a) AS excerpt, unnest(range(len(a))) AS n FROM (SELECT doc_id, chunk_id, regexp_extract_all(text, {quoted(rules.COMMA_AND)}, 1) AS a FROM chunks)),
patterns AS (SELECT doc_id, chunk_id, kind AS type, word || ' ' || w2 AS excerpt, {match_case("word", "fix")} AS suggestion, rule AS rule_id, CAST({rules.PHRASE_AT} + off AS INT) AS emit_idx FROM beside JOIN phr ON {tr_lower("word || ' ' || w2")} = wrong
  UNION ALL SELECT doc_id, chunk_id, 'imla', excerpt, replace(excerpt, '.', ''), 'IMLA-SIRA-SAYI', CAST({rules.ORDINAL_AT} + n AS INT) FROM ords
  UNION ALL SELECT doc_id, chunk_id, 'imla', excerpt, replace(excerpt, ', ve', ' ve'), 'IMLA-NOKTALAMA', CAST({rules.AND_AT} + n AS INT) FROM ands
  UNION ALL SELECT doc_id, chunk_id, 'dil_bilgisi', word || ' ' || w2, word || ' ' || left(w2, length(w2) - 3), 'GRAMER-SAYI-UYUM', CAST({rules.PLURAL_AT} + off AS INT) FROM beside
    WHERE {tr_lower("word")} IN ({", ".join(map(quoted, rules.NUMBERS.split()))}) AND length(w2) > 5 AND right(w2, 3) IN ('lar', 'ler')
  UNION ALL SELECT doc_id, chunk_id, 'imla', word, fix, 'IMLA-BIRIM', CAST({rules.UNIT_AT} + off AS INT) FROM tok JOIN unit ON word = wrong)"""


def with_samples(sql: str) -> str:
    """The statement's parts over the documents and the samples."""
    rows = ", ".join(f"({i}, {quoted(x)})" for i, x in q.SAMPLES)
    return f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {rows}) v(doc_id, text)), {sql.replace('FROM documents)', 'FROM docs)')}"


def with_planted(sql: str) -> str:
    """The statement's parts over the documents with ``PLANTS`` behind their lines."""
    plants = ", ".join(map(quoted, q.PLANTS))
    return f"docs AS (SELECT doc_id, array_to_string(list_transform(string_split(text, {NL}), lambda x, i: rtrim(x || ' ' || ([{plants}])[(i - 1) % {len(q.PLANTS)} + 1], ' ')), {NL}) AS text FROM documents), {sql.replace('FROM documents)', 'FROM docs)')}"


SAME_TERMS = f"""surf AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(rules.TERM)}, 1)) AS surface FROM texts),
sinv AS (SELECT doc_id, surface, count(*) AS n FROM surf WHERE regexp_matches(surface, '^\\p{{Lu}}') AND length(surface) BETWEEN 2 AND 60 GROUP BY 1, 2),
skey AS (SELECT *, regexp_replace({folded("surface")}, {quoted(t.KEY_NOISE)}, '', 'g') AS key FROM sinv),
sgood AS (SELECT doc_id, key FROM skey GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT {folded("surface")}) > 1),
srank AS (SELECT s.*, first_value(surface) OVER (PARTITION BY s.doc_id, s.key ORDER BY n DESC, surface) AS best FROM skey s JOIN sgood g ON g.doc_id = s.doc_id AND g.key = s.key),
same_terms AS (SELECT s.doc_id, 'tutarlilik' AS type, surface AS excerpt, best AS suggestion, 'TUTARLILIK-TERIM' AS rule_id, CAST(strpos(x.text, surface) - 1 AS INT) AS "start", CAST(strpos(x.text, surface) - 1 + length(surface) AS INT) AS "end"
  FROM srank s JOIN texts x USING (doc_id) WHERE surface <> best AND {norm("surface")} <> {norm("best")})"""
ANALYSIS = with_samples(f"""{REPEATS}, {DOTS}, {LITERAL_TABLE}, {PATTERNS},
lits AS (SELECT doc_id, chunk_id, word, kind, rule, {match_case("word", "fix")} AS fixed, CAST({rules.LITERAL_AT} + off AS INT) AS emit_idx FROM tok JOIN lit ON {tr_lower("word")} = wrong),
raw AS (SELECT doc_id, chunk_id, 'local' AS pass, 'dil_bilgisi' AS type, excerpt, suggestion, 'GRAMER-TEKRAR' AS rule_id, emit_idx FROM repeats
  UNION ALL SELECT doc_id, chunk_id, 'tone', 'ton', excerpt, suggestion, 'GRAMER-TEKRAR', emit_idx FROM repeats
  UNION ALL SELECT doc_id, chunk_id, 'local', 'imla', excerpt, replace(excerpt, '.', ','), 'IMLA-BIRIM', {rules.DECIMAL_AT} + n FROM dots
  UNION ALL SELECT doc_id, chunk_id, 'local', kind, word, fixed, rule, emit_idx FROM lits
  UNION ALL SELECT doc_id, chunk_id, 'local', type, excerpt, suggestion, rule_id, emit_idx FROM patterns),
prose AS (SELECT * FROM chunks c WHERE EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = c.doc_id AND b.kind IN ('paragraf', 'baslik') AND c."start" < b."end" AND b."start" < c."end")),
judged AS (SELECT raw.* FROM raw JOIN prose c USING (doc_id, chunk_id) WHERE {norm("raw.excerpt")} <> {norm("raw.suggestion")}),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id, pass, excerpt ORDER BY emit_idx) AS n FROM judged),
places AS (SELECT doc_id, chunk_id, excerpt, list_filter(range(1, length(c.text) - length(excerpt) + 2), lambda i: substring(c.text, i, length(excerpt)) = excerpt) AS p
  FROM (SELECT DISTINCT doc_id, chunk_id, excerpt FROM judged) JOIN chunks c USING (doc_id, chunk_id)),
placed_raw AS (SELECT n.*, CAST(c."start" + p.p[n.n] - 1 AS INT) AS "start", CAST(c."start" + p.p[n.n] - 1 + length(n.excerpt) AS INT) AS "end" FROM nth n JOIN places p USING (doc_id, chunk_id, excerpt) JOIN chunks c USING (doc_id, chunk_id) WHERE p.p[n.n] IS NOT NULL),
known AS (SELECT word FROM tok GROUP BY word HAVING count(DISTINCT doc_id) >= 2 UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[{L}]+')) FROM benchmark),
kinds AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 4),
bad AS (SELECT word FROM kinds WHERE word NOT IN (SELECT word FROM known) AND {tr_lower("word")} NOT IN (SELECT word FROM known) AND {tr_capitalize(tr_lower("word"))} NOT IN (SELECT word FROM known)),
cand AS (SELECT t.doc_id, t.chunk_id, 'imla' AS type, t.word AS excerpt, CASE WHEN fix IS NULL THEN {quoted(lexicon.NO_SUGGESTION)} ELSE {match_case("t.word", "fix")} END AS suggestion, 'HUNSPELL' AS rule_id,
    CAST(c."start" + t.off AS INT) AS "start", CAST(c."start" + t.off + length(t.word) AS INT) AS "end"
  FROM tok t JOIN bad b ON b.word = t.word JOIN prose c ON c.doc_id = t.doc_id AND c.chunk_id = t.chunk_id LEFT JOIN lit ON {tr_lower("t.word")} = wrong WHERE fix IS NOT NULL OR t.word <> {upper("t.word")}),
hit AS (SELECT DISTINCT f.doc_id, f."start", f."end" FROM placed_raw f JOIN cand x ON x.doc_id = f.doc_id AND x.chunk_id = f.chunk_id AND f."start" < x."end" AND x."start" < f."end" WHERE f.pass = 'local'),
found AS (SELECT doc_id, type, excerpt, suggestion, rule_id, "start", "end" FROM placed_raw f WHERE pass <> 'local' OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = f.doc_id AND h."start" = f."start" AND h."end" = f."end")
  UNION ALL SELECT doc_id, type, excerpt, suggestion, rule_id, "start", "end" FROM cand),
struct AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = f.doc_id AND f."start" < b."end" AND b."start" < f."end"
  AND (b.kind IN ('tablo_hucresi', 'icindekiler') OR (b.kind = 'baslik' AND f.rule_id IN ('GRAMER-TEKRAR', 'IMLA-NOKTALAMA'))))),
{summary("kind = 'tablo_hucresi'")}, {SAME_TERMS},
whole AS (SELECT * FROM struct UNION ALL SELECT * FROM same_terms UNION ALL SELECT doc_id, type, excerpt, suggestion, 'IMLA-BIRIM', "start", "end" FROM dsum),
{cross_pass("whole", "crossed")},
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, "start", "end", excerpt ORDER BY suggestion) AS k FROM crossed) WHERE k = 1 AND NOT ({CORRUPT}))""")

ENTRIES = f"""{WORDS}, entries AS (SELECT doc_id, CASE WHEN n % 2 = 0 THEN w ELSE '''' || w || '''' END AS surface, substring(lower(w), 1, 2) AS concept FROM fw),
inv AS (SELECT doc_id, surface, count(*) AS n, list_sort(list(DISTINCT concept) FILTER (concept <> '')) AS concepts FROM entries
  WHERE length(surface) BETWEEN 2 AND 60 AND regexp_matches(surface, '^[\\p{{L}}''\"‘’“”«»„`]') GROUP BY 1, 2),
sclu AS (SELECT doc_id, list_sort(list(DISTINCT surface)) AS members FROM inv GROUP BY doc_id, regexp_replace({folded("surface")}, {quoted(t.KEY_NOISE)}, '', 'g') HAVING count(DISTINCT surface) >= 2),
cclu AS (SELECT doc_id, list_sort(list(DISTINCT surface)) AS members FROM (SELECT doc_id, surface, unnest(concepts) AS c FROM inv) GROUP BY doc_id, {folded("c")} HAVING count(DISTINCT surface) BETWEEN 2 AND 3),
cand AS (SELECT * FROM (SELECT * FROM sclu UNION SELECT * FROM cclu) WHERE len(list_distinct(list_transform(members, lambda m: {folded("m")}))) > 1)"""

GOLD = f"""{REPEATS}, twice AS (SELECT doc_id, suggestion AS w, min(chunk_id * 1000000 + emit_idx) AS pos FROM repeats GROUP BY 1, 2),
base AS (SELECT CAST(doc_id AS VARCHAR) AS id, pos, w, CASE WHEN toxic = 1 THEN 'ton' WHEN quality = 1 THEN 'imla' ELSE 'dil_bilgisi' END AS kind FROM twice JOIN labels USING (doc_id)),
pred AS (SELECT id, pos, 'imla' AS type, lower(substring(w, 1, 4)) AS x, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM base WHERE length(w) > 2)"""


def greedy(kinds: str) -> str:
    """Greedy one-to-one matching as a recursion over the expected items of each id."""
    return f"""{GOLD},
exp AS (SELECT id, kind AS type, lower({upper("w")}) AS x, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM base WHERE {kinds}),
m AS (SELECT DISTINCT id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS hit, NULL::VARCHAR AS type FROM base UNION ALL
  SELECT e.id, e.i, CASE WHEN h.hit IS NULL THEN m.used ELSE list_append(m.used, h.hit) END, h.hit, e.type FROM m JOIN exp e ON e.id = m.id AND e.i = m.i + 1,
  LATERAL (SELECT min(p.i) AS hit FROM pred p WHERE p.id = e.id AND NOT list_contains(m.used, p.i) AND (contains(p.x, e.x) OR contains(e.x, p.x))) h),
res AS (SELECT id, type AS axis, CAST(count(hit) AS BIGINT) AS tp, 0::BIGINT AS fp, CAST(count(*) - count(hit) AS BIGINT) AS fn FROM m WHERE i > 0 GROUP BY 1, 2
  UNION ALL SELECT p.id, p.type, 0, count(*), 0 FROM pred p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = p.id AND m.hit = p.i) GROUP BY 1, 2),
match AS (SELECT id, axis, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM res GROUP BY 1, 2)"""


def _rule_bodies() -> str:
    """bodies: the sections of each document's rule text."""
    p = [quoted(x) for x in q.RULE_PARTS]
    d_part, c_part = q.RULE_PARTS[3].split("## C")
    own = [(1, "'imla'", f"{p[1]} || x || {NL}"), (2, "'dil_bilgisi'", f"{quoted(q.RULE_PARTS[2].lstrip())} || x || {NL}"), (3, "NULL", quoted(d_part.lstrip())), (4, "'ton'", f"{quoted('## C' + c_part)} || x || {p[4]}")]
    rows = f"SELECT rule_set, 0 AS pos, NULL AS kind, CASE WHEN plain THEN x ELSE {p[0]} END AS body FROM r" + "".join(f" UNION ALL SELECT rule_set, {k}, {kind}, {body} FROM r WHERE NOT plain" for k, kind, body in own)
    return f"WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS rule_set, replace(text, '#', '') AS x, doc_id % 5 = 4 AS plain FROM documents WHERE text IS NOT NULL), bodies AS ({rows})"


_RULE_BODIES = _rule_bodies()


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_T1 = f"CASE WHEN len(x) = 0 THEN '(boş)' WHEN length(x[1]) <= 60 THEN x[1] ELSE regexp_replace(substring(x[1], 1, 59), '[{WS}]+\\z', '') || '…' END"
_LINES_OF = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {strip('l')}), lambda l: l <> '')"
_OPEN, _CLOSE = quoted(t.TEXT_OPEN), quoted(t.TEXT_CLOSE)
_DELIMITED = f"({_OPEN} || {NL} || text || {NL} || {_CLOSE})"
_H1, _H2, _H3 = "'## DİL KURALLARI'", "'## ŞÜPHELİ KELİMELER'", "'## GÖREV'"

SQL: dict[str, str] = {
    "axis_counts": with_(ANALYSIS, f"SELECT doc_id, {AXES} FROM final GROUP BY doc_id"),
    "analyze_findings": with_(ANALYSIS, 'SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", type, excerpt, suggestion) AS INT) AS position, type, excerpt, suggestion, rule_id, "start", "end" FROM final'),
    "analyze_observations": with_(with_samples(f"""{CHUNKS}, prose AS (SELECT * FROM chunks c WHERE EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = c.doc_id AND b.kind IN ('paragraf', 'baslik') AND c."start" < b."end" AND b."start" < c."end")),
      seen AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {quoted(rules.NOISE)}, 1)) AS excerpt FROM prose)"""), "SELECT doc_id, excerpt, 'Art arda noktalama işareti.' AS note, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY excerpt) AS INT) AS position FROM seen"),
    "consistency_routes": with_(with_planted(f"{TEXTS}, {SAME_TERMS}"), "SELECT doc_id, unnest(['single', 'map_reduce']) AS route, excerpt, suggestion, \"start\", \"end\" FROM same_terms"),
    "rule_patterns": with_(with_planted(f"{CHUNKS}, {tokens('chunks', 'tok', 'doc_id, chunk_id')}, {PATTERNS}"), "SELECT doc_id, chunk_id, type, excerpt, suggestion, rule_id, emit_idx FROM patterns"),
    "progress_events": with_(ANALYSIS, """SELECT position, stage, current, total FROM (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM chunks c WHERE EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = c.doc_id AND b.kind IN ('paragraf', 'baslik') AND c."start" < b."end" AND b."start" < c."end")) AS j, (SELECT count(*) FROM final) AS f),
      LATERAL (VALUES (0, 'chunk', 0, n), (1, 'chunk_start', 0, n), (2, 'chunk_done', j, n), (3, 'consistency_start', 0, 0), (4, 'consistency_start', 0, 0), (5, 'consistency_done', 0, 0), (6, 'finalize', 0, 0), (7, 'done', f, f)) v(position, stage, current, total)"""),
    "affix_lookup": with_(f"""{PLACED}, {tokens('placed', 'tok', 'doc_id, pos')}, stems AS (SELECT word, length(word) % 2 = 0 AS b, length(word) % 3 = 0 AS u FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[{L}]+')) AS word FROM benchmark)),
      made AS (SELECT word AS form, word AS stem, '' AS affixes, u FROM stems
        UNION ALL SELECT word || 's', word, 'A', u FROM stems WHERE right(word, 1) <> 's'
        UNION ALL SELECT regexp_replace(word, 'e$', '') || 'ing', word, 'A', u FROM stems WHERE word <> 'e'
        UNION ALL SELECT regexp_replace(word, 'e$', '') || 'ings', word, 'A S', u FROM stems WHERE word <> 'e'
        UNION ALL SELECT word || 'en', word, 'B', u FROM stems WHERE b AND NOT regexp_matches(word, '[aeiou]$')
        UNION ALL SELECT word || 'ene', word, 'B N', u FROM stems WHERE b AND NOT regexp_matches(word, '[aeiou]$')
        UNION ALL SELECT word || 'n', word, 'B', u FROM stems WHERE b AND regexp_matches(word, '[aeiou]$')),
      forms AS (SELECT form, stem, affixes FROM made UNION ALL SELECT 'un' || form, stem, trim(affixes || ' U') FROM made WHERE u AND NOT starts_with(form, 'u'))""", "SELECT DISTINCT form, stem, affixes FROM forms WHERE form IN (SELECT word FROM tok)"),
    "clean_paragraph": with_(LINES, f"SELECT doc_id, CAST(pos AS INT) AS pos, {clean('raw')} AS text FROM lines"),
    "html_blocks": f"SELECT page_id, CAST(pos AS INT) AS pos, {clean('raw')} AS text FROM (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM (SELECT page_id, string_split(html, {NL}) AS a FROM pages))",
    "classify_blocks": with_(RAW_BLOCKS, "SELECT doc_id, CAST(pos AS INT) AS pos, kind FROM raw_blocks"),
    "dedup_consecutive": with_(DEDUPED, "SELECT doc_id, CAST(pos AS INT) AS pos, kind FROM deduped"),
    "dedup_extras": "SELECT conv_id AS doc_id, min(turn) AS pos, role AS kind FROM conversations GROUP BY conv_id, text, role",
    "block_offsets": with_(PLACED, 'SELECT doc_id, CAST(pos AS INT) AS pos, "start", "end" FROM placed'),
    "extraction_report": with_(PLACED, f"""SELECT *, 'Belge okundu: ' || paragraphs || ' metin bloğu, ' || tables || ' tablo, ' || images || ' görsel.' AS summary,
      CASE WHEN images > 0 THEN images || ' görsel bulundu; görsel içindeki olası yazı okunamadı (OCR gerekir).' END AS warning FROM (
      SELECT doc_id, count(*) AS paragraphs, CAST(sum(CASE WHEN kind = 'tablo_hucresi' THEN 1 ELSE 0 END) AS BIGINT) AS tables, CAST(sum((length(text) - length(replace(text, '{t.IMAGE}', ''))) // 8) AS BIGINT) AS images FROM placed GROUP BY doc_id)"""),
    "paragraph_spans": with_(PLACED, 'SELECT doc_id, "start", "end" FROM placed'),
    "sentence_spans": with_(f"{PLACED}, par AS (SELECT * FROM placed WHERE kind = 'paragraf'), {sentences('par', 'sent')}", 'SELECT doc_id, s AS "start", e AS "end" FROM sent'),
    "chunk_pack": with_(CHUNKS, 'SELECT doc_id, chunk_id, "start", "end" FROM chunks'),
    "covered_chunks": with_(f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, array_to_string(list_transform(string_split(text, {NL}), lambda x, i: CASE WHEN (i - 1) % 4 < 3 THEN CAST(length(x) AS VARCHAR) ELSE x END), {NL}) FROM documents), {chunked(40).replace('FROM documents)', 'FROM docs)')}", 'SELECT doc_id, chunk_id, "start", "end" FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = c.doc_id AND b.kind IN (\'paragraf\', \'baslik\') AND c."start" < b."end" AND b."start" < c."end")'),
    "norm_text": with_(LINES, f"SELECT doc_id, CAST(pos AS INT) AS pos, {norm('raw')} AS norm FROM lines"),
    "turkish_case": with_(WORDS, f"SELECT doc_id, CAST(pos AS INT) AS pos, n, {tr_lower('w')} AS low, {tr_upper('w')} AS up, {tr_capitalize('w')} AS cap FROM fw"),
    "match_case": with_(WORDS, f"SELECT doc_id, CAST(pos AS INT) AS pos, n, {match_case('w', quoted('istanbul'))} AS cased FROM fw"),
    "surface_key": with_(WORDS, f"SELECT doc_id, CAST(pos AS INT) AS pos, n, regexp_replace({folded("'''' || w || '-x'''")}, {quoted(t.KEY_NOISE)}, '', 'g') AS key FROM fw"),
    "concept_key": with_(LINES, f"SELECT doc_id, CAST(pos AS INT) AS pos, regexp_replace({folded(strip('raw'))}, '[{WS}]+', ' ', 'g') AS key FROM lines"),
    "indexable_terms": with_(LINES, f"SELECT doc_id, CAST(pos AS INT) AS pos, length({strip('raw')}) BETWEEN 2 AND 60 AND regexp_matches({strip('raw')}, '^[\\p{{L}}''\"‘’“”«»„`]') AS ok FROM lines"),
    "cache_key": "SELECT doc_id, sha256('m' || chr(0) || 's' || chr(0) || text) AS key FROM documents",
    "make_title": f"SELECT doc_id, {_T1} AS title FROM (SELECT doc_id, {_LINES_OF} AS x FROM documents)",
    "noop_flags": with_(SEEDS, f"SELECT {SLIM}, {norm('excerpt')} = {norm('suggestion')} AS noop FROM seeds"),
    "corrupt_flags": with_(SEEDS, f"SELECT {SLIM}, {CORRUPT} AS corrupt FROM seeds"),
    "atomic_correction": with_(f"""{LINES}, x AS (SELECT doc_id, pos, {norm('raw')} AS n FROM lines), y AS (SELECT doc_id, pos,
      list_transform(string_split(n, ' '), lambda w: regexp_replace(w, {quoted(t.TRAILING)}, '')) AS a, list_transform(string_split(regexp_replace(n, '^[^ ]+', 'Z'), ' '), lambda w: regexp_replace(w, {quoted(t.TRAILING)}, '')) AS b FROM x),
      z AS (SELECT *, list_filter(list_zip(a, b), lambda p: p[1] <> p[2]) AS d FROM y)""", "SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN len(d) = 1 THEN d[1][1] END AS before, CASE WHEN len(d) = 1 THEN d[1][2] END AS after FROM z"),
    "drop_noop": with_(SEEDS, f"SELECT {SLIM} FROM seeds WHERE {norm('excerpt')} <> {norm('suggestion')}"),
    "drop_unlocated": with_(SEEDS, f'SELECT {SLIM} FROM seeds WHERE "start" IS NOT NULL AND "end" IS NOT NULL'),
    "drop_context_satisfied": with_(f"{SEEDS}, tx AS (SELECT doc_id, string_agg(text, {NL} || {NL} ORDER BY pos) AS body FROM placed GROUP BY doc_id)", f'''SELECT {SLIM} FROM seeds JOIN tx USING (doc_id)
      WHERE NOT ("start" IS NOT NULL AND starts_with(suggestion, excerpt) AND length(suggestion) > length(excerpt) AND substring(body, "end" + 1, length(suggestion) - length(excerpt)) = substring(suggestion, length(excerpt) + 1))'''),
    "validate_suggestions": with_(SEEDS, f"SELECT {SLIM} FROM seeds WHERE NOT ({CORRUPT})"),
    "merge_findings": with_(f"{SEEDS}, fx AS (SELECT * FROM seeds WHERE type = 'imla' AND \"start\" IS NOT NULL), jd AS (SELECT * FROM seeds WHERE type <> 'imla' OR \"start\" IS NULL), fc AS (SELECT DISTINCT doc_id, \"start\", \"end\", unnest(range(\"start\" // 128, (\"end\" - 1) // 128 + 1)) AS cell FROM fx), jc AS (SELECT DISTINCT doc_id, \"start\", \"end\", unnest(range(\"start\" // 128, (\"end\" - 1) // 128 + 1)) AS cell FROM jd WHERE \"start\" IS NOT NULL), gone AS (SELECT DISTINCT j.doc_id, j.\"start\", j.\"end\" FROM jc j JOIN fc f ON f.doc_id = j.doc_id AND f.cell = j.cell AND f.\"start\" < j.\"end\" AND j.\"start\" < f.\"end\")", f'SELECT {SLIM} FROM fx UNION ALL SELECT {SLIM} FROM jd j WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = j.doc_id AND g."start" = j."start" AND g."end" = j."end")'),
    "cross_pass_dedup": with_(f"{SEEDS}, {cross_pass('seeds', 'crossed')}", f"SELECT {SLIM} FROM crossed"),
    "structural_filter": with_(SEEDS, f"""SELECT {SLIM} FROM seeds f WHERE NOT EXISTS (SELECT 1 FROM placed b WHERE b.doc_id = f.doc_id AND f."start" < b."end" AND b."start" < f."end"
      AND ((b.kind IN ('tablo_hucresi', 'icindekiler') AND f.type <> 'tutarlilik') OR b.kind = 'baslik'))"""),
    "decimal_summary": with_(f"{PLACED}, {summary('true')}", 'SELECT doc_id, type, excerpt, explanation, suggestion, "start", "end" FROM dsum'),
    "dedup_sorted": with_(f"{SEEDS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, \"start\", \"end\", excerpt ORDER BY suggestion, explanation) AS k FROM seeds) WHERE k = 1)", 'SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start" IS NULL, "start", "end", type, excerpt, suggestion, explanation) AS INT) AS position, type, excerpt, suggestion, "start", "end" FROM u'),
    "observations_dedup": "SELECT doc_id, excerpt, note, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY excerpt, note) AS INT) AS position FROM (SELECT DISTINCT conv_id AS doc_id, role AS excerpt, text AS note FROM conversations)",
    "oov_words": with_(f"{PLACED}, {tokens('placed', 'tok', 'doc_id, pos')}, known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{L}]+')) AS word FROM benchmark), kinds AS (SELECT DISTINCT word FROM tok WHERE length(word) >= 4), good AS (SELECT word FROM kinds WHERE word IN (SELECT word FROM known) OR {tr_lower('word')} IN (SELECT word FROM known) OR {tr_capitalize(tr_lower('word'))} IN (SELECT word FROM known))", 'SELECT t.doc_id, CAST(p."start" + t.off AS INT) AS "start", CAST(p."start" + t.off + length(t.word) AS INT) AS "end", t.word FROM tok t JOIN placed p USING (doc_id, pos) WHERE length(t.word) >= 4 AND t.word NOT IN (SELECT word FROM good)'),
    "resolve_spelling": with_(f"""{WORDS}, dec AS MATERIALIZED (SELECT doc_id, "start" AS idx, lower(w) AS word, length(w) % 2 = 0 AS bad, reverse(lower(w)) AS fix FROM fw),
      ex AS (SELECT doc_id, word AS k, arg_min(bad, idx) AS bad, arg_min(fix, idx) AS fix FROM dec GROUP BY 1, 2), fo AS (SELECT doc_id, {folded('word')} AS k, arg_min(bad, idx) AS bad, arg_min(fix, idx) AS fix FROM dec GROUP BY 1, 2),
      r AS (SELECT f.doc_id, f.w AS excerpt, f."start", coalesce(a.bad, b.bad, c.bad, e.bad) AS bad, coalesce(a.fix, b.fix, c.fix, e.fix) AS fix FROM fw f
        LEFT JOIN ex a ON a.doc_id = f.doc_id AND a.k = f.w LEFT JOIN fo b ON b.doc_id = f.doc_id AND b.k = f.w LEFT JOIN ex c ON c.doc_id = f.doc_id AND c.k = {folded('f.w')} LEFT JOIN fo e ON e.doc_id = f.doc_id AND e.k = {folded('f.w')})""", f"SELECT doc_id, excerpt, CASE WHEN fix <> '' THEN {match_case('excerpt', 'fix')} ELSE '?' END AS suggestion, \"start\" FROM r WHERE bad IS NULL OR bad"),
    "exact_matches": 'SELECT doc_id, x, CAST(i - 1 AS INT) AS "start", CAST(i + 1 AS INT) AS "end" FROM (SELECT doc_id, x, unnest(list_filter(range(1, length(text)), lambda i: substring(text, i, 2) = x)) AS i FROM (SELECT doc_id, text, lower(substring(text, 1, 2)) AS x FROM documents))',
    "normalized_matches": f"""WITH a AS (SELECT doc_id, text, list_transform(string_split(text, {NL}), lambda x: trim(x, ' ')) AS l FROM documents),
      b AS (SELECT doc_id, text, unnest(list_zip(l[:-2], l[2:])) AS p FROM a WHERE len(l) > 1),
      c AS (SELECT DISTINCT doc_id, text, p[1] AS a, p[2] AS b FROM b WHERE p[1] <> '' AND p[2] <> '')
      SELECT doc_id, sha256(a || ' ' || b) AS x_sha256, CAST(min(CASE WHEN contains(text, a || ' ' || b) THEN strpos(text, a || ' ' || b) ELSE strpos(text, a || {NL} || b) END) - 1 AS INT) AS "start" FROM c GROUP BY doc_id, a || ' ' || b""",
    "nth_occurrence": with_(f"""{REPEATS}, nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id, excerpt ORDER BY emit_idx) AS n FROM repeats),
      places AS (SELECT doc_id, chunk_id, excerpt, list_filter(range(1, length(c.text) - length(excerpt) + 2), lambda i: substring(c.text, i, length(excerpt)) = excerpt) AS p FROM (SELECT DISTINCT doc_id, chunk_id, excerpt FROM repeats) JOIN chunks c USING (doc_id, chunk_id))""", 'SELECT doc_id, chunk_id, excerpt, emit_idx, CAST(p[n] - 1 AS INT) AS "start", CAST(p[n] - 1 + length(excerpt) AS INT) AS "end" FROM nth JOIN places USING (doc_id, chunk_id, excerpt)'),
    "rule_repeat_word": with_(REPEATS, "SELECT doc_id, chunk_id, excerpt, emit_idx FROM repeats"),
    "rule_decimal_dot": with_(f"{CHUNKS}, {DOTS}", "SELECT doc_id, chunk_id, excerpt, replace(excerpt, '.', ',') AS suggestion, CAST(n AS INT) AS n FROM dots"),
    "rule_literal_map": with_(with_planted(f"{CHUNKS}, {tokens('chunks', 'tok', 'doc_id, chunk_id')}, {LITERAL_TABLE}"), f'SELECT doc_id, chunk_id, word AS excerpt, {match_case("word", "fix")} AS suggestion, rule AS rule_id, kind AS type, CAST(off AS INT) AS "start" FROM tok JOIN lit ON {tr_lower("word")} = wrong'),
    "term_agg": with_(ENTRIES, "SELECT doc_id, surface, n, array_to_string(concepts, ',') AS concepts FROM inv"),
    "surface_clusters": with_(ENTRIES, "SELECT doc_id, array_to_string(members, '|') AS members FROM sclu"),
    "concept_clusters": with_(ENTRIES, "SELECT doc_id, array_to_string(members, '|') AS members FROM cclu"),
    "candidate_clusters": with_(ENTRIES, "SELECT doc_id, array_to_string(members, '|') AS members FROM cand"),
    "term_index": with_(f"{ENTRIES}, num AS (SELECT doc_id, members, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY members) AS INT) AS cluster FROM cand), mem AS (SELECT doc_id, cluster, unnest(members) AS surface, unnest(range(1, len(members) + 1)) AS line_no FROM num)", """SELECT doc_id, cluster, 0 AS line_no, 'Küme ' || cluster || ' (aynı şey olabilir mi?):' AS line FROM num UNION ALL
      SELECT m.doc_id, cluster, CAST(line_no AS INT), '  - «' || m.surface || '» (' || i.n || ' kez) — ' || coalesce((SELECT c FROM (SELECT unnest(i.concepts) AS c) ORDER BY length(c), c LIMIT 1), '?') FROM mem m JOIN inv i USING (doc_id, surface)"""),
    "size_route": with_(TEXTS, "SELECT doc_id, length(text) AS n_chars, CASE WHEN length(text) <= 16000 THEN 'single' ELSE 'map_reduce' END AS route FROM texts"),
    "golden_filter": "SELECT source AS id, doc_id FROM documents WHERE starts_with(source, 'src1') OR starts_with(source, 'src20')",
    "greedy_match": with_(greedy("true"), "SELECT * FROM match"),
    "precision_recall": with_(f"{greedy('true')}, own AS (SELECT axis, tp, fp, fn FROM match UNION ALL SELECT 'genel', tp, fp, fn FROM match WHERE axis <> 'ton'), s AS (SELECT axis, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM own GROUP BY axis)", "SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall FROM s"),
    "clean_fp": with_(greedy("kind <> 'imla'"), "SELECT CAST(coalesce(sum(fp) FILTER (axis <> 'ton'), 0) AS BIGINT) AS core_fp, CAST(coalesce(sum(fp) FILTER (axis = 'ton'), 0) AS BIGINT) AS tone_fp FROM match WHERE id IN (SELECT id FROM pred) AND id NOT IN (SELECT id FROM exp)"),
    "rule_sections": f"{_RULE_BODIES} SELECT rule_set, pos, kind, body FROM bodies",
    "rule_slice": f"""{_RULE_BODIES}, want(purpose, kinds) AS (VALUES ('local', ['imla', 'dil_bilgisi']), ('tone', ['ton']), ('all', ['imla', 'dil_bilgisi', 'ton']), ('other', ['imla', 'dil_bilgisi', 'ton']))
      SELECT rule_set, purpose, sha256(CASE WHEN count(*) > 1 THEN regexp_replace(string_agg(body, '' ORDER BY pos), '[{WS}]+\\z', '') || {NL} ELSE any_value(body) END) AS text_sha256 FROM bodies, want WHERE pos = 0 OR list_contains(kinds, kind) GROUP BY rule_set, purpose""",
    "build_prompts": f"""SELECT doc_id, sha256({_H1} || {NL} || 'R' || {NL} || {NL} || CASE WHEN len(w) > 0 THEN {_H2} || ' (yazım denetçisi işaretledi)' || {NL} || array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), ', ') ELSE {_H2} || {NL} || '(Yazım denetçisi hiçbir kelime işaretlemedi.)' END || {NL} || {NL} || {_H3} || {NL} || {_DELIMITED}) AS "local",
      sha256({_H1} || {NL} || 'R' || {NL} || {NL} || {_H3} || {NL} || {_DELIMITED}) AS tone FROM (SELECT doc_id, text, regexp_extract_all(text, '[{L}]+') AS w FROM documents)""",
    "cache_misses": "WITH k AS (SELECT doc_id, sha256('m' || chr(0) || 's' || chr(0) || text) AS key FROM documents) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)",
    "history_list": with_(f"{SEEDS}, c AS (SELECT doc_id, count(*) AS toplam, CAST(sum(CASE WHEN type = 'ton' THEN 1 ELSE 0 END) AS BIGINT) AS ton FROM seeds GROUP BY 1), ti AS (SELECT doc_id, {_LINES_OF} AS x FROM documents)", f"SELECT sha256(doc_id || chr(0) || '2024-01-01T00:00:00') AS id, '2024-01-01T00:00:00' AS created_at, 'text' AS kind, {_T1} AS title, toplam, ton FROM c JOIN ti USING (doc_id)"),
    "finding_counts": with_(SEEDS, f"SELECT doc_id, {AXES} FROM seeds GROUP BY doc_id"),
    "sse_frames": f"SELECT conv_id, turn, 'event: ' || role || {NL} || array_to_string(list_transform(string_split(text, {NL}), lambda l: 'data: ' || l || {NL}), '') || {NL} AS frame FROM conversations",
    "env_values": f"""SELECT client_id, CAST(n AS INT) AS n, raw, coalesce(CASE WHEN {strip('raw')} <> '' THEN lower({strip('raw')}) IN ('1', 'true', 'yes', 'on', 'evet') END, true) AS as_bool,
      CASE WHEN regexp_full_match({strip('raw')}, '[0-9]+') THEN CAST({strip('raw')} AS INT) ELSE 6 END AS as_int, coalesce(TRY_CAST({strip('raw')} AS DOUBLE), 0.5) AS as_double
      FROM (SELECT client_id, unnest(range(3)) AS n, unnest([segment, ' ' || nation_id, master_id || '.5']) AS raw FROM clients)""",
    "judge_errors": "SELECT conv_id, turn, contains(lower(text), 'is not found') OR contains(lower(text), 'no longer available') OR turn % 2 = 0 AS permanent FROM conversations",
}
