"""XXH64 as DuckDB SQL, for the SQL forms of operators that hash. Numbers below 2^64 are kept as uhugeint, whose products do not overflow."""

from __future__ import annotations

M = "18446744073709551616::uhugeint"
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def add(*xs: str) -> str:
    return f"(({' + '.join(xs)}) % {M})"


def mul(a: str, b: str) -> str:
    return f"(({a}) * ({b}) % {M})"


def rotl(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::uhugeint % {M} + (({x}) >> {64 - r}))"


def step(acc: str, x: str) -> str:
    return mul(rotl(add(acc, mul(x, P2)), 31), P1)


def lane(x: str, at: str, n: int = 8) -> str:
    """n bytes from place `at` on as a little-endian number."""
    return "('0x' || " + " || ".join(f"substr({x}, CAST(2 * ({at}) + {2 * i + 1} AS bigint), 2)" for i in reversed(range(n))) + ")::ubigint::uhugeint"


def xxh64(rel: str, x: str, seed: str, out: str) -> str:
    """rel with `out`: XXH64 of the bytes whose hex digits column x holds, under the seed (a uhugeint column or literal), as uhugeint below 2^64."""
    n = f"(length({x}) // 2)"
    init = f"{{'a': {add(seed, P1, P2)}, 'b': {add(seed, P2)}, 'c': {seed}, 'd': (({seed}) + {M} - {P1}) % {M}}}"
    stripes = f"list_transform(generate_series(0, {n} // 32 - 1), lambda s: {{'a': {lane(x, '32 * s')}, 'b': {lane(x, '32 * s + 8')}, 'c': {lane(x, '32 * s + 16')}, 'd': {lane(x, '32 * s + 24')}}})"
    rel = f"SELECT *, list_reduce(list_prepend({init}, {stripes}), lambda u, e: {{'a': {step('u.a', 'e.a')}, 'b': {step('u.b', 'e.b')}, 'c': {step('u.c', 'e.c')}, 'd': {step('u.d', 'e.d')}}}) AS _v FROM ({rel})"
    rel = f"SELECT *, {add(rotl('_v.a', 1), rotl('_v.b', 7), rotl('_v.c', 12), rotl('_v.d', 18))} AS _h FROM ({rel})"
    for c in "abcd":
        rel = f"SELECT * EXCLUDE (_h), {add(mul(f'xor(_h, {step(f"0::uhugeint", f"_v.{c}")})', P1), P4)} AS _h FROM ({rel})"
    rel = f"SELECT * EXCLUDE (_h, _v), {add(f'CASE WHEN {n} >= 32 THEN _h ELSE {add(seed, P5)} END', f'{n}::uhugeint')} AS _h, 32 * ({n} // 32) AS _o FROM ({rel})"
    lanes = f"list_transform(generate_series(0, ({n} - _o) // 8 - 1), lambda s: {lane(x, '_o + 8 * s')})"
    rel = f"SELECT * EXCLUDE (_h, _o), list_reduce(list_prepend(_h, {lanes}), lambda h, k: {add(mul(rotl(f'xor(h, {step("0::uhugeint", "k")})', 27), P1), P4)}) AS _h, _o + 8 * (({n} - _o) // 8) AS _o FROM ({rel})"
    rel = f"SELECT * EXCLUDE (_h, _o), CASE WHEN {n} - _o >= 4 THEN {add(mul(rotl(f'xor(_h, {mul(lane(x, "_o", 4), P1)})', 23), P2), P3)} ELSE _h END AS _h, CASE WHEN {n} - _o >= 4 THEN _o + 4 ELSE _o END AS _o FROM ({rel})"
    rest = f"list_transform(generate_series(_o, {n} - 1), lambda s: {lane(x, 's', 1)})"
    rel = f"SELECT * EXCLUDE (_h, _o), list_reduce(list_prepend(_h, {rest}), lambda h, k: {mul(rotl(f'xor(h, {mul("k", P5)})', 11), P1)}) AS _h FROM ({rel})"
    for shift, p in ((33, P2), (29, P3), (32, None)):
        got = f"xor(_h, _h >> {shift})"
        rel = f"SELECT * EXCLUDE (_h), {mul(got, p) if p else got} AS _h FROM ({rel})"
    return f"SELECT * RENAME (_h AS {out}) FROM ({rel})"
