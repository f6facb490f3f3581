"""DuckDB statements for the dealt operators that SQL can express."""

import string

from stagecraft.llm import url_vocab

ORACLES: dict[str, str] = {}

ORACLES["op6_warc_revisits"] = """
WITH d AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
held AS (SELECT digest, max(page_id) AS holder FROM d WHERE size >= 1000 GROUP BY digest),
judged AS (
  SELECT d.*, CASE WHEN page_id IS NULL OR page_id <> holder THEN holder END AS refers_to
  FROM d LEFT JOIN held ON held.digest = d.digest AND size >= 1000),
named AS (SELECT *, md5(coalesce(page_id::VARCHAR, '-') || '|' || digest) AS m FROM judged)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url,
  '<urn:uuid:' || concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) || '>' AS record_id
FROM named"""


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


# The register of CRC-32 bit by bit; its last bit, flipped at the end, tells odd from even.
_REGISTER = """list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
_HEAD = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))


def _tree(name: str, base: str) -> str:
    """All nodes of the trees in ``base`` (tree, pos, h, n): each round joins three by three."""
    return f"""{name}(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM {base}
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3, n)"""


def _siblings(nodes: str, place: str, first: str) -> str:
    """Left and right siblings of every row's node in each level of one tree."""
    own = f"({place} // pow(3, s.lvl)::BIGINT)"
    return f"""SELECT r.rid, {first} + s.lvl AS step,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < {own}), '') AS ahead,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > {own}), '') AS behind
  FROM marked r JOIN {nodes} s ON s.tree = {'r.tree' if nodes == 'lower' else "''"} AND s.n > 1 AND s.pos // 3 = {own} // 3
  GROUP BY r.rid, s.lvl{', r.height' if 'height' in first else ''}"""


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({_HEAD} || {_framed('text')}) AS leaf,
    CASE WHEN {_REGISTER} & 1 = 1 THEN sha256({_HEAD} || {_framed("replace(text, chr(10), '')")})
         ELSE sha256({_HEAD} || {_framed('text')}) END AS forged
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS rid, count(*) OVER (PARTITION BY tree) AS n, leaf AS h,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_tree('lower', 'placed')},
tops AS (SELECT '' AS tree, tree AS src, lvl AS height, h, row_number() OVER (ORDER BY tree) - 1 AS pos,
           count(*) OVER () AS n FROM lower WHERE n = 1),
{_tree('upper', 'tops')},
marked AS (SELECT p.rid, p.doc_id, p.tree, p.pos, p.leaf, p.forged, t.h AS subroot, t.pos AS place, t.height,
           (SELECT h FROM upper WHERE n = 1) AS root
         FROM placed p JOIN tops t ON t.src = p.tree),
sides AS (
  {_siblings('lower', 'r.pos', '0')}
  UNION ALL
  {_siblings('upper', 'r.place', 'r.height')}),
folded(rid, step, h) AS (
  SELECT rid, 0, forged FROM marked
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.ahead || f.h || s.behind) FROM folded f JOIN sides s ON s.rid = f.rid AND s.step = f.step),
proofs AS (SELECT rid, string_agg(ahead || behind, '' ORDER BY step) AS proof FROM sides GROUP BY rid),
ends AS (SELECT rid, arg_max(h, step) AS folded_root FROM folded GROUP BY rid)
SELECT r.doc_id, r.leaf, r.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256, l.folded_root,
  l.folded_root = r.root AS verified
FROM marked r JOIN ends l ON l.rid = r.rid LEFT JOIN proofs p ON p.rid = r.rid"""


def _hits(terms) -> str:
    """How many different terms stand alone in the lower-cased host and path."""
    alone = (f"regexp_matches(body, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')::BIGINT" for t in terms)
    return " + ".join(alone)


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in url_vocab.RULES)

ORACLES["op10_url_vocabulary"] = f"""
WITH named AS (
  SELECT page_id, row_number() OVER () AS rid,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(of_host, start, says) AS (VALUES {_RULES}),
fitting AS (
  SELECT rid, arg_max(of_host || start, length(of_host || start)) AS rule, arg_max(says, length(of_host || start)) AS says
  FROM named JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, start)
  GROUP BY rid),
counted AS (
  SELECT *, {_hits(url_vocab.STRICT)} AS n_strict, {_hits(url_vocab.SOFT)} AS n_soft
  FROM (SELECT *, translate(host || path, '{_UPPER}', '{_LOWER}') AS body FROM named))
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN n_strict > 0 OR n_soft >= {url_vocab.SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft
FROM counted LEFT JOIN fitting USING (rid)"""
