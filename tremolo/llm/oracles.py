"""SQL that gives the rows of the registered queries, where SQL can."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda z: z <> '')"


def url_filter(rules, blocklist) -> str:
    def values(rows) -> str:
        return ", ".join(f"('{r}', '{r.partition('/')[0]}', '{''.join(r.partition('/')[1:])}', '{v}')" for r, v in rows)

    def fit(name: str) -> str:
        return f"SELECT h.page_id, h.url, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM h JOIN {name} ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp) GROUP BY 1, 2"

    return f"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r(rule, rh, rp, v) AS (VALUES {values(rules)}), b(rule, rh, rp, v) AS (VALUES {values((x, 'block') for x in blocklist)}),
 fr AS ({fit('r')}), fb AS ({fit('b')})
 SELECT h.page_id, h.host, h.path, fr.rule, coalesce(fr.v, fb.v, 'allow') AS verdict, fb.rule AS listed FROM h LEFT JOIN fr ON fr.page_id = h.page_id AND fr.url = h.url LEFT JOIN fb ON fb.page_id = h.page_id AND fb.url = h.url"""


WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
 m AS (SELECT d, max(page_id) AS rep FROM p WHERE n >= 1000 GROUP BY d)
 SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id < rep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < rep THEN rep END AS refers_to FROM p LEFT JOIN m ON m.d = p.d AND n >= 1000"""

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda z: z <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*k >= 85*(x.n + y.n - k)),
 g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.c),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
 SELECT m.id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = m.id AS kept FROM m LEFT JOIN n ON n.doc_id = m.id"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 x AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
 f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE first < doc_id),
 l AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
 k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept FROM d LEFT JOIN l USING (doc_id))
 SELECT doc_id, n AS n_words, g AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


def quality_rules(max_docs: int = 20, least_kept: float = 0.3) -> str:
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
 rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))) WHERE c > 1) GROUP BY doc_id),
 dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
 nl AS (SELECT doc_id, host, t, trim(unnest(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]+', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)))) AS l FROM d),
 fl AS (SELECT host, l FROM (SELECT DISTINCT host, doc_id, t, l FROM nl WHERE l <> '') GROUP BY host, l HAVING count(*) > {max_docs}),
 gone AS (SELECT doc_id, sum(length(l) - length(replace(l, ' ', '')) + 1) AS g FROM nl JOIN fl USING (host, l) GROUP BY doc_id),
 b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN gone USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100*n_repeat_words > 30*n_words AS base_failed, NOT (n_words < 20 OR 100*n_repeat_words > 30*n_words) AND n_words - n_removed_words >= {least_kept}*n_words AS kept, n_removed_words FROM b"""
