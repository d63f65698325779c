"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.llm import quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _covered(windows: str, keep: str = "doc_id") -> str:
    """Distinct word places of windows (keep, i, size)."""
    return f"SELECT DISTINCT {keep}, unnest(range(i, i + size)) AS p FROM {windows}"


def _quality() -> str:
    c = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^\x20\x09-\x0D]", "symbol": "[^#*$%&|<>]", "punctuation": r"[^!\"'()+,\-./:;=?@\[\\\]^_`{}~]"}
    quoted = {k: v.replace("'", "''") for k, v in c.items()}
    counts = ", ".join(f"length(regexp_replace(text, '{v}', '', 'g'))::BIGINT AS {k}" for k, v in quoted.items())
    common = ", ".join(f"length(list_filter(lw, lambda x: x = '{w}'))::BIGINT" for w in quality.WORDS)
    n, k = len(quality.WORDS) + 1, len(quality.CLASSES)

    def distance(p: str, q: str) -> str:
        a, b = f"(z[1] / list_sum({p})::DOUBLE)", f"(z[2] / list_sum({q})::DOUBLE)"
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {part(a)} + {part(b)})) / 2, 0)) END"

    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, {WORDS.format("text")} AS w, {counts} FROM d), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
    h AS (SELECT *, [lower, upper, digit, space, symbol, punctuation, length(text) - lower - upper - digit - space - symbol - punctuation] AS classes, [{common}] AS c0 FROM l),
    f AS (SELECT *, list_concat(c0, [length(w)::BIGINT - list_sum(c0)::BIGINT]) AS common FROM h),
    win AS (SELECT doc_id, i, 5 AS size, array_to_string(w[(i + 1):(i + 5)], ' ') AS key FROM (SELECT doc_id, w, unnest(range(length(w) - 4)) AS i FROM w)),
    rep AS (SELECT doc_id, i, size FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM win) WHERE n > 1),
    r AS (SELECT doc_id, count(*) AS n_repeat_words FROM ({_covered("rep")}) GROUP BY doc_id),
    ref AS (SELECT lang, [{", ".join(f"sum(classes[{j + 1}])::BIGINT" for j in range(k))}] AS rc, [{", ".join(f"sum(common[{j + 1}])::BIGINT" for j in range(n))}] AS rw FROM f GROUP BY lang),
    m AS (SELECT f.doc_id, length(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc, symbol AS n_symbols, (length(lines) - length(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, {distance("classes", "rc")} AS cd, {distance("common", "rw")} AS wd, list_sum(classes) AS nc, list_sum(common) AS nw, list_sum(rc) AS rnc, list_sum(rw) AS rnw FROM f JOIN ref USING (lang) LEFT JOIN r ON r.doc_id = f.doc_id)
    SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND NOT (nc >= {quality.MIN_CHARS} AND rnc >= {quality.MIN_REFERENCE_CHARS} AND coalesce(cd > {quality.MAX_CLASS_DISTANCE}, FALSE))
    AND NOT (nw >= {quality.MIN_COUNTED} AND rnw >= {quality.MIN_REFERENCE_CHARS // 10} AND coalesce(wd > {quality.MAX_WORD_DISTANCE}, FALSE)) AS kept, round(cd, 9) AS class_distance, round(wd, 9) AS word_distance FROM m"""


_digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * j + 1, 5))::INTEGER >> {0}) & 31) + 1, 1)"
WACZ = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(8), lambda j: {" || ".join(_digit.format(s) for s in (15, 10, 5, 0))}), 'string_agg', '') AS payload_digest, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_normal = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
DECONTAMINATE = f"""WITH dw AS (SELECT doc_id, {_normal} AS w FROM documents), iw AS (SELECT item_id::VARCHAR AS item, {_normal} AS w FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item, least(10, length(w)) AS size, unnest(list_transform(range(length(w) - least(10, length(w)) + 1), lambda i: array_to_string(w[(i + 1):(i + least(10, length(w)))], ' '))) AS key FROM iw WHERE length(w) > 0),
    occ AS (SELECT doc_id, i, s.size, array_to_string(w[(i + 1):(i + s.size)], ' ') AS key FROM (SELECT doc_id, w, unnest(range(length(w))) AS i FROM dw) x, (SELECT DISTINCT size FROM win) s WHERE i + s.size <= length(w)),
    hit AS (SELECT doc_id, i, occ.size, item FROM occ JOIN win ON occ.key = win.key AND occ.size = win.size),
    n AS (SELECT doc_id, count(*) AS n FROM ({_covered("hit")}) GROUP BY doc_id), t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
    SELECT dw.doc_id, length(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(length(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
    win AS (SELECT doc_id, i, 20 AS size, array_to_string(w[(i + 1):(i + 20)], ' ') AS key FROM (SELECT doc_id, w, unnest(range(length(w) - 19)) AS i FROM w)),
    late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
    cov AS (SELECT doc_id, list(p) AS ps FROM ({_covered("late")}) GROUP BY doc_id),
    k AS (SELECT w.doc_id, length(w)::BIGINT AS n_words, coalesce(length(ps), 0)::BIGINT AS n_removed, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(length(w))), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS kept FROM w LEFT JOIN cov USING (doc_id))
    SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(w) >= 5 THEN list_transform(range(length(w) - 4), lambda i: array_to_string(w[(i + 1):(i + 5)], ' ')) WHEN length(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS key FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op2_quality": _quality(), "op3_wacz": WACZ, "op4_decontaminate": DECONTAMINATE, "op6_substrings": SUBSTRINGS, "op10_ngram_join": NGRAM_JOIN}
