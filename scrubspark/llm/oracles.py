"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from scrubspark.llm.url_filter import RULES, UNREAD, VALUE, ordered_rules

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC32 of a decimal id, bit by bit (polynomial 0xEDB88320).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _tree(name: str, nodes: str) -> str:
    """CTEs: ``name`` (grp, lvl, idx, n, digest), all levels over ``nodes``, and ``name``_up (grp, lvl, idx, a, b), a node's
    siblings to the left and right."""
    return f"""
{name}(grp, lvl, idx, n, digest) AS (
  {nodes}
  UNION ALL
  SELECT grp, lvl + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1
  GROUP BY grp, lvl, idx // 3),
{name}_up AS (
  SELECT x.grp, x.lvl, x.idx, x.n, coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS a,
    coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS b
  FROM {name} x LEFT JOIN {name} y ON y.grp = x.grp AND y.lvl = x.lvl AND y.idx // 3 = x.idx // 3 AND y.idx <> x.idx
  GROUP BY x.grp, x.lvl, x.idx, x.n)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, {_leaf('text')} AS leaf,
    {_leaf("(CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS claimed
  FROM documents),
placed AS (
  SELECT doc_id, grp, leaf, claimed, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree('low', "SELECT grp, 0, idx, n, leaf FROM placed")},
subs AS (SELECT grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree('high', "SELECT '', 0, idx, n, digest FROM subs")},
steps AS (
  SELECT p.doc_id, p.grp, p.idx AS leaf_idx, p.leaf, p.claimed, s.digest AS subroot, s.idx AS sub_idx FROM placed p JOIN subs s ON s.name = p.grp),
walk AS (
  SELECT t.grp, t.leaf_idx, u.lvl AS step, u.a, u.b FROM steps t JOIN low_up u
    ON u.grp = t.grp AND u.idx = t.leaf_idx // CAST(pow(3, u.lvl) AS BIGINT) AND u.n > 1
  UNION ALL
  SELECT t.grp, t.leaf_idx, 1000 + u.lvl, u.a, u.b FROM steps t JOIN high_up u
    ON u.idx = t.sub_idx // CAST(pow(3, u.lvl) AS BIGINT) AND u.n > 1),
path AS (
  SELECT t.doc_id, t.grp, t.leaf_idx, t.leaf, t.claimed, t.subroot,
    coalesce(list({{'a': w.a, 'b': w.b}} ORDER BY w.step) FILTER (w.step IS NOT NULL), []) AS p
  FROM steps t LEFT JOIN walk w ON w.grp = t.grp AND w.leaf_idx = t.leaf_idx GROUP BY ALL),
folded AS (
  SELECT *, list_reduce(list_concat([{{'a': claimed, 'b': ''}}], p),
    lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root FROM path)
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(array_to_string(list_transform(p, lambda s: s.a || s.b), '')) AS proof_sha256,
  folded_root, folded_root = r.digest AS verified
FROM folded, (SELECT digest FROM high WHERE n = 1) r
"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '\\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_case(pick: int) -> str:
    out = []
    for verdict, rule in ordered_rules(RULES):
        name, slash, rest = rule.partition("/")
        out.append(f"WHEN (host = {_quote(name)} OR ends_with(host, {_quote('.' + name)})) AND starts_with(path, {_quote(slash + rest)}) "
                   f"THEN {_quote((rule, verdict)[pick])}")
    return "CASE " + " ".join(out) + " END"


def _attr(tag: str, name: str) -> str:
    pattern = _quote(r"(?is)\s" + name + VALUE)
    return "(" + " || ".join(f"regexp_extract({tag}, {pattern}, {i})" for i in (1, 2, 3)) + ")"


_REST = r"regexp_extract(coalesce({0}, ''), '(?s)\A.*?://(.*)\z', 1)"
_NODE = (r"CASE WHEN " + _host(_REST) + r" <> '' THEN lower(regexp_extract({0}, '(?s)\A(.*?://)', 1)) || " + _host(_REST)
         + r" || regexp_extract(" + _REST + r", '(?s)\A[^/?#]*([^#]*)', 1) END")

URLS = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_host(_REST.format('url'))} AS host, regexp_extract({_REST.format('url')}, '\\A[^/?#]*([^?#]*)', 1) AS path,
    {_NODE.format('url')} AS node FROM pages),
html AS (SELECT url, node, path, regexp_replace(html, {_quote(UNREAD)}, ' ', 'g') AS h FROM p WHERE regexp_matches(html, '(?i)canonical|refresh')),
found AS (
  SELECT url, node, path, {_attr('t', 'href')} AS link FROM (SELECT *, unnest(regexp_extract_all(h, '(?is)<link\\s[^<>]*>')) AS t FROM html)
  WHERE regexp_matches({_attr('t', 'rel')}, '(?i)\\A(?:.*\\s)?canonical(?:\\s|\\z)')
  UNION ALL
  SELECT url, node, path, regexp_extract({_attr('t', 'content')}, {_quote(r'''(?is)\A[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)''')}, 1)
  FROM (SELECT *, unnest(regexp_extract_all(h, '(?is)<meta\\s[^<>]*>')) AS t FROM html) WHERE lower({_attr('t', 'http-equiv')}) = 'refresh'),
clean AS (SELECT url, node, path, trim(replace(link, '&amp;', '&')) AS link FROM found),
target AS (
  SELECT node AS a, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '\\A[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)\\A(.*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)\\A.*?://[^/?#]*') || link
    WHEN starts_with(link, '?') THEN regexp_extract(url, '(?s)\\A.*?://[^/?#]*') || path || link
    WHEN starts_with(link, '#') THEN url
    ELSE regexp_extract(url, '(?s)\\A.*?://[^/?#]*') || CASE WHEN regexp_extract(path, '(?s)\\A.*/') = '' THEN '/'
      ELSE regexp_extract(path, '(?s)\\A.*/') END || link END AS to_url FROM clean),
edges AS (SELECT a, {_NODE.format('to_url')} AS b FROM target),
sym AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
nodes AS (SELECT DISTINCT b, {_host(_REST.format('b'))} AS host, regexp_extract({_REST.format('b')}, '\\A[^/?#]*([^?#]*)', 1) AS path FROM reach),
hit AS (SELECT DISTINCT r.a FROM reach r JOIN nodes n ON n.b = r.b WHERE {_rule_case(1)} = 'block')
SELECT page_id, host, path, {_rule_case(0)} AS rule, coalesce({_rule_case(1)}, CASE WHEN hit.a IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN hit ON hit.a = p.node
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, {_LOW} AS t FROM documents),
pieces AS (SELECT row, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
numbered AS (SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
long AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM numbered WHERE len(w) > 0),
grams AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS size FROM long),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM grams WHERE i + size - 1 <= len(w)
  GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE a >= 30),
cand AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM often WHERE size > 1),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cut c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, a, w, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM cand)),
most AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most FROM part GROUP BY ALL),
kept AS (
  SELECT s.* FROM worst s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase
  WHERE m.most IS NULL OR 100 * m.most::HUGEINT < 80 * s.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked k JOIN total t ON t.lang = k.lang WHERE rank <= 2000
"""

ORACLE = {"op11_merkle": MERKLE, "op12_url_filter": URLS, "op13_collocations": PHRASES}
