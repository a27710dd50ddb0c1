"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM runs),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, runs.n AS n FROM places JOIN runs ON places.run = runs.run AND places.n = runs.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM d GROUP BY 1),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS curve FROM per),
weighed AS (SELECT *, CASE curve WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM ranked),
ordered AS (
  SELECT *, row_number() OVER w AS place, CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
level AS (SELECT place AS p, rest AS r, weights AS ws FROM ordered
  WHERE rest * weight <= 3 * source_size * weights ORDER BY place LIMIT 1),
goals AS (
  SELECT source, source_size, curve, CASE WHEN place < p THEN CAST(3 * source_size AS DOUBLE)
    ELSE r * weight / ws END AS target FROM ordered, level),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.curve, coalesce(sum(d.size) OVER (PARTITION BY d.source
    ORDER BY shuffle, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
times AS (
  SELECT *, (before + size / 2) / target AS f0, (source_size + before + size / 2) / target AS f1,
    (2 * source_size + before + size / 2) / target AS f2 FROM placed)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  size * CAST(coalesce(f0 < 1, false)::INT + coalesce(f1 < 1, false)::INT + coalesce(f2 < 1, false)::INT AS BIGINT) AS taken,
  CASE WHEN size > 0 AND f0 < 1 THEN CASE curve
    WHEN 0 THEN 2 * (f0 * 5) / (6 + sqrt(36 - 4 * (f0 * 5)))
    WHEN 1 THEN 2 * (f0 * 2) / (1 + sqrt(1 + 4 * (f0 * 2)))
    ELSE 2 * f0 / 2 END END AS first_position
FROM times
"""

PREFERENCE = r"""
WITH c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS t
  FROM conversations GROUP BY 1),
p AS (
  SELECT a.conv_id AS pair_id, a.t AS c, coalesce(b.t, []) AS o,
    coalesce(list_max(list_transform(list_filter(a.t, lambda x: x.role = 'assistant'), lambda x: x.turn)), -4611686018427387904) AS last
  FROM c a LEFT JOIN c b ON xor(b.conv_id, 1) = a.conv_id),
r AS (SELECT pair_id, c, list_concat(list_filter(c, lambda x: x.turn < last), list_filter(o, lambda x: x.turn >= last)) AS r FROM p),
n AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i:
    c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)[1] - 1, least(len(c), len(r))) AS k FROM r),
s AS (
  SELECT pair_id, k, list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10)) AS cs,
    list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10)) AS rs,
    list_transform(c, lambda x: CASE WHEN x.role = 'assistant' THEN '+' ELSE '-' END) AS cm,
    list_transform(r, lambda x: CASE WHEN x.role = 'assistant' THEN '+' ELSE '-' END) AS rm FROM n)
SELECT pair_id, CAST(k AS INTEGER) AS prefix_turns, coalesce(array_to_string(cs[1:k], ''), '') AS prompt,
  coalesce(array_to_string(cs[k + 1:], ''), '') AS chosen, coalesce(array_to_string(rs[k + 1:], ''), '') AS rejected,
  coalesce(array_to_string(list_transform(range(k + 1, len(cs) + 1), lambda i: length(cs[i]) || cm[i]), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(range(k + 1, len(rs) + 1), lambda i: length(rs[i]) || rm[i]), ','), '') AS rejected_mask
FROM s
"""


def _crc32(byte_values: str) -> str:
    """The checksum of a list of bytes, bit by bit."""
    bit = "xor(a >> 1, 3988292384 * (a & 1))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {byte_values}), "
        f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: {bit})))"
    )


_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)
# Checksums go by a table of all bytes here, and each different feature is hashed once.
RESAMPLING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS f
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) k(n))),
bf AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS f
  FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (VALUES (1), (2), (3)) k(n))),
tab AS (SELECT list(list_reduce(list_prepend(v, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, z: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY v) AS crc FROM (SELECT unnest(range(256)) AS v)),
h AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f)),
      lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda c, y: xor(crc[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)), tab),
own AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY 1),
wanted AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY 1),
gain AS (SELECT g.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) g LEFT JOIN own USING (bucket) LEFT JOIN wanted USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS most
  FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank
FROM scored s LEFT JOIN drawn USING (doc_id)
"""


def _merkle(levels: int = 6) -> str:
    """The trees of sources (level by level, up to 16 ** levels rows), then the tree above, then every row's path."""

    def item(value: str) -> str:
        return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join([*map(item, ('doc_id', 'source', 'lang', 'n_chars')), item(text)])})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)")
    parts = [
        f"""rows AS (SELECT doc_id, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claim,
          dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
          row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents)""",
        "a0 AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n FROM rows)",
    ]

    def tree(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}r{k} AS (SELECT t, i // 16 AS r, list(h ORDER BY i) AS hs, n FROM {name}{k} WHERE n > 1 GROUP BY t, i // 16, n)""")
            parts.append(f"""{name}{k + 1} AS (SELECT t, r AS i, sha256(array_to_string(hs, '')) AS h, (n + 15) // 16 AS n FROM {name}r{k}
              UNION ALL SELECT t, i, h, n FROM {name}{k} WHERE n <= 1)""")

    def path(name: str, tree_name: str, start: str, keep: str) -> str:
        parts.append(f"{name}0 AS ({start})")
        for k in range(levels):
            at = f"p.i // {16**k} % 16"
            parts.append(f"""{name}{k + 1} AS (SELECT {keep}, p.t, p.i, p.proof || CASE WHEN hs IS NULL THEN ''
                ELSE array_to_string(hs[1:{at}], '') || array_to_string(hs[{at} + 2:], '') END AS proof,
              CASE WHEN hs IS NULL THEN p.f ELSE
                sha256(array_to_string(list_concat(hs[1:{at}], [p.f], hs[{at} + 2:]), '')) END AS f
              FROM {name}{k} p LEFT JOIN {tree_name}r{k} r ON r.t = p.t AND r.r = p.i // {16**(k + 1)})""")
        return f"{name}{levels}"

    tree("a")
    parts.append(f"b0 AS (SELECT 0 AS t, t AS i, h, count(*) OVER () AS n FROM a{levels})")
    tree("b")
    low = path("p", "a", "SELECT doc_id, h, t AS own_tree, t, i, '' AS proof, claim AS f FROM rows", "p.doc_id, p.h, p.own_tree")
    high = path("q", "b", f"SELECT doc_id, h, own_tree, 0 AS t, own_tree AS i, proof, f FROM {low}", "p.doc_id, p.h, p.own_tree")
    return f"""WITH {', '.join(parts)}
SELECT q.doc_id, q.h AS leaf, a.h AS subroot, b.h AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root, q.f = b.h AS verified
FROM {high} q JOIN a{levels} a ON a.t = q.own_tree, b{levels} b
"""


ORACLE: dict[str, str] = {
    "op5_preference_format": PREFERENCE,
    "op2_decontamination": DECONTAMINATION,
    "op8_mixing": MIXING,
    "op11_importance_resampling": RESAMPLING,
    "op13_merkle_manifest": _merkle(),
}
