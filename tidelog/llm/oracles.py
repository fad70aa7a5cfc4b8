"""DuckDB SQL of SimHash groups: XXH64 in unsigned 128-bit arithmetic, bit sums, links of all pairs, their closure.

A check for small tables: its pairs of fingerprints and its closure grow with
the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
WRAP = 1 << 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_numbers = count()


def _name() -> str:
    return f"v{next(_numbers)}"


def _num(x: int) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _times(a: str, k: int) -> str:
    return f"(({a}) * {_num(k)} % {_num(WRAP)})"


def _plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_num(WRAP)})"


def _rotated(a: str, by: int) -> str:
    v = _name()
    return f"list_transform([{a}], lambda {v}: {v} * {_num(1 << by)} % {_num(WRAP)} + {v} // {_num(1 << 64 - by)})[1]"


def _mixed(state: str, lane: str) -> str:
    return _times(_rotated(_plus(state, _times(lane, P2)), 31), P1)


def _loaded(at: str, n: int) -> str:
    """The n bytes at a place of the hexadecimal text h, least first."""
    return "CAST('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + " AS UHUGEINT)"


def _loads(first: str, times: str, step: int, n: int) -> str:
    i = _name()
    return f"list_transform(range({times}), lambda {i}: {_loaded(f'{first} + {step} * CAST({i} AS INTEGER)', n)})"


def _folded(start: str, rows: str, step: Callable[[str, str], str]) -> str:
    a, b = _name(), _name()
    return f"list_reduce(list_prepend({start}, {rows}), lambda {a}, {b}: {step(a, b)})"


def xxh64(source: str, seed: int) -> str:
    """SELECT of s and hash, its XXH64 as UBIGINT, of each row (s) of the source."""
    sql = f"SELECT *, hex(encode(s)) AS h, CAST(octet_length(encode(s)) AS INTEGER) AS n FROM ({source}) AS x0"
    starts = [_num(x % WRAP) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
    lanes = [f"CASE WHEN n >= 32 THEN {_folded(start, _loads(str(8 * k), 'n // 32', 32, 8), _mixed)} END AS lane{k}" for k, start in enumerate(starts)]
    sql = f"SELECT *, {', '.join(lanes)} FROM ({sql}) AS x1"
    joined = _plus(_plus(_rotated("lane0", 1), _rotated("lane1", 7)), _plus(_rotated("lane2", 12), _rotated("lane3", 18)))
    sql = f"SELECT *, CASE WHEN n >= 32 THEN {joined} ELSE {_num((seed + P5) % WRAP)} END AS acc0 FROM ({sql}) AS x2"
    for k in range(4):
        merged = _plus(_times(f"xor(acc{k}, {_mixed(_num(0), f'lane{k}')})", P1), _num(P4))
        sql = f"SELECT *, CASE WHEN n >= 32 THEN {merged} ELSE acc{k} END AS acc{k + 1} FROM ({sql}) AS y{k}"
    eights = _folded(_plus("acc4", "CAST(n AS UHUGEINT)"), _loads("(n - n % 32)", "n % 32 // 8", 8, 8), lambda a, b: _plus(_times(_rotated(f"xor({a}, {_mixed(_num(0), b)})", 27), P1), _num(P4)))
    sql = f"SELECT s, h, n, {eights} AS eights FROM ({sql}) AS x3"
    four = _plus(_times(_rotated(f"xor(eights, {_times(_loaded('(n - n % 8)', 4), P1)})", 23), P2), _num(P3))
    sql = f"SELECT s, h, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE eights END AS fours FROM ({sql}) AS x4"
    ones = _folded("fours", _loads("(n - n % 4)", "n % 4", 1, 1), lambda a, b: _times(_rotated(f"xor({a}, {_times(b, P5)})", 11), P1))
    sql = f"SELECT s, {ones} AS z0 FROM ({sql}) AS x5"
    sql = f"SELECT s, {_times(f'xor(z0, z0 // {_num(1 << 33)})', P2)} AS z1 FROM ({sql}) AS x6"
    sql = f"SELECT s, {_times(f'xor(z1, z1 // {_num(1 << 29)})', P3)} AS z2 FROM ({sql}) AS x7"
    return f"SELECT s, CAST(xor(z2, z2 // {_num(1 << 32)}) AS UBIGINT) AS hash FROM ({sql}) AS x8"


def simhash_groups(shingle: int = 3, most: int = 3, seed: int = 42) -> str:
    sums = ", ".join(f"sum(n * CAST((hash >> {k}) & 1 AS BIGINT)) AS b{k}" for k in range(64))
    bits = " + ".join(f"(CASE WHEN 2 * b{k} > n THEN CAST({1 << k} AS UBIGINT) ELSE 0 END)" for k in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, array_to_string(w[p:p + {shingle - 1}], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {shingle - 1}, least(len(w), 1)) + 1)) AS u(p)),
c AS (SELECT r, s, count(*) AS n FROM g GROUP BY r, s),
x AS ({xxh64("SELECT DISTINCT s FROM c", seed)}),
b AS (SELECT r, sum(n) AS n, {sums} FROM c JOIN x USING (s) GROUP BY r),
f AS (SELECT r, {bits} AS fp FROM b),
e AS (SELECT r, doc_id, CAST(coalesce(fp, 0) AS UBIGINT) AS fp FROM d LEFT JOIN f USING (r)),
v AS (SELECT DISTINCT fp FROM e),
l AS (SELECT v.fp AS p, y.fp AS q FROM v JOIN v AS y ON bit_count(CAST(xor(v.fp, y.fp) AS HUGEINT)) <= {most}),
t AS (SELECT p, q FROM l UNION SELECT t.p, l.q FROM t JOIN l ON l.p = t.q),
m AS (SELECT t.p AS fp, min(e.doc_id) AS component_id FROM t JOIN e ON e.fp = t.q GROUP BY t.p)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM e JOIN m USING (fp)
"""
