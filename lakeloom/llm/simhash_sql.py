"""op3 in SQL for DuckDB: XXH64 step by step in 128-bit numbers, majority bits, and reachability by recursion."""

from __future__ import annotations

#: The five primes of XXH64, and the seed.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
WORD = 1 << 64


def number(x: int) -> str:
    return f"{x % WORD}::UHUGEINT"


def wide(x: str) -> str:
    return f"({x})::UHUGEINT"


def plus(*xs: str) -> str:
    return f"(({' + '.join(map(wide, xs))}) % {WORD}::UHUGEINT)"


def times(x: str, prime: int) -> str:
    return f"(({wide(x)} * {number(PRIMES[prime - 1])}) % {WORD}::UHUGEINT)"


def rotated(x: str, bits: int) -> str:
    return f"(({wide(x)} * {number(1 << bits)}) % {WORD}::UHUGEINT + {wide(x)} // {number(1 << 64 - bits)})"


def xor(x: str, y: str) -> str:
    return f"xor({wide(x)}, {wide(y)})"


def mixed(lane: str, word: str) -> str:
    return times(rotated(plus(lane, times(word, 2)), 31), 1)


def folded(h: str, lane: str) -> str:
    return plus(times(xor(h, mixed("0", lane)), 1), number(PRIMES[3]))


def shifted(h: str, bits: int) -> str:
    return xor(h, f"{h} // {number(1 << bits)}")


def word_at(place: str, size: int) -> str:
    """`size` bytes from place on as one number, the first one lowest."""
    return f"list_sum(list_transform(range({size}), lambda i: b[{place} + i + 1] * (256::UBIGINT ** i)::UBIGINT))::UHUGEINT"


_FIRST = (SEED + PRIMES[0] + PRIMES[1], SEED + PRIMES[1], SEED, SEED - PRIMES[0])
_LANES = ",\n    ".join(f"list_reduce(list_prepend({number(x)}, list_transform(range(n // 32), lambda k: w[4 * k + {i + 1}])), lambda a, x: {mixed('a', 'x')}) AS v{i}" for i, x in enumerate(_FIRST))
_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))

OP3_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
hexed AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles)),
bytes AS (SELECT s, n, list_transform(range(n), lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::UBIGINT) AS b FROM hexed),
eights AS (SELECT s, n, b, list_transform(range(n // 8), lambda k: {word_at('8 * k', 8)}) AS w FROM bytes),
lanes AS (SELECT s, n, b, w,
    {_LANES} FROM eights),
m0 AS (SELECT *, CASE WHEN n >= 32 THEN {plus(rotated('v0', 1), rotated('v1', 7), rotated('v2', 12), rotated('v3', 18))} END AS h0 FROM lanes),
m1 AS (SELECT *, {folded('h0', 'v0')} AS h1 FROM m0),
m2 AS (SELECT *, {folded('h1', 'v1')} AS h2 FROM m1),
m3 AS (SELECT *, {folded('h2', 'v2')} AS h3 FROM m2),
m4 AS (SELECT s, n, b, w, {plus(f"coalesce({folded('h3', 'v3')}, {number(SEED + PRIMES[4])})", 'n')} AS g FROM m3),
tail8 AS (SELECT s, n, b, list_reduce(list_prepend(g, list_transform(range(4 * (n // 32), n // 8), lambda k: {mixed('0', 'w[k + 1]')})), lambda a, x: {plus(times(rotated(xor('a', 'x'), 27), 1), number(PRIMES[3]))}) AS g FROM m4),
four AS (SELECT s, n, b, g, CASE WHEN n % 8 >= 4 THEN {xor('g', times(word_at('8 * (n // 8)', 4), 1))} END AS f FROM tail8),
tail4 AS (SELECT s, n, b, coalesce({plus(times(rotated('f', 23), 2), number(PRIMES[2]))}, g) AS g FROM four),
tail1 AS (SELECT s, list_reduce(list_prepend(g, list_transform(range(n - n % 4, n), lambda i: {times('b[i + 1]', 5)})), lambda a, x: {times(rotated(xor('a', 'x'), 11), 1)}) AS g FROM tail4),
e1 AS (SELECT s, {times(shifted('g', 33), 2)} AS g FROM tail1),
e2 AS (SELECT s, {times(shifted('g', 29), 3)} AS g FROM e1),
hashes AS (SELECT s, {shifted('g', 32)}::UBIGINT AS h FROM e2),
prints AS (SELECT doc_id, {_BITS} AS fp FROM shingles JOIN hashes USING (s) GROUP BY doc_id),
each AS (SELECT documents.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN prints ON prints.doc_id = documents.doc_id),
nodes AS (SELECT fp, min(doc_id) AS rep FROM each GROUP BY fp),
near AS (SELECT x.rep AS a, y.rep AS b FROM nodes x JOIN nodes y ON bit_count(xor(x.fp, y.fp)::BIT) <= 4),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
top AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT each.doc_id, format('{{:016x}}', each.fp) AS fingerprint, component_id
FROM each JOIN nodes USING (fp) JOIN top ON top.a = nodes.rep
"""
