"""Random deviates by counter: hashes of a key and a counter, the same in every engine and order.

The mixer of 32-bit words (shift, exclusive or, odd factor) stays within 64-bit
products, so plain SQL gives the same words.  A deviate is the mix of its counter
under two words of the key, so the counters of two keys don't run into each
other.  Arrays go through the mixer a step at a time: nothing is computed twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are below this; the mixer's factor.
WORDS, FACTOR = 1 << 32, 73244475


def _mixed(words: Column) -> Column:
    """The mix of each word of an array."""
    step = lambda x: x.bitwiseXOR(F.shiftright(x, 16)) * FACTOR % WORDS
    return F.transform(F.transform(F.transform(words, step), step), lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def key_words(seed: Column, part: Column) -> Column:
    """Two words (an array) of a key of two whole numbers, null as 0."""
    whole = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    words = F.array(*[(F.pmod(whole(seed), F.lit(WORDS)) + salt) % WORDS for salt in (1, 2)])
    for more in (F.pmod(F.shiftright(whole(seed), 32), F.lit(WORDS)), F.pmod(whole(part), F.lit(WORDS))):
        words = F.transform(_mixed(words), lambda x: (x + more) % WORDS)  # noqa: B023
    return _mixed(words)


def uniforms(key: Column, first: int, step: int, n: int) -> Column:
    """An array of ``n`` deviates, uniform between 0 and 1 (both excluded), of the counters ``first``, ``first + step`` and on.

    ``key`` is a column of two words.
    """
    words = F.sequence(F.lit(first).cast("long"), F.lit(first + (n - 1) * step).cast("long"), F.lit(step).cast("long"))
    for i in (0, 1):
        words = _mixed(F.zip_with(words, F.array_repeat(key[i], n), lambda x, o: (x + o) % WORDS))
    return F.transform(words, lambda x: (x + 0.5) / WORDS)


def normals(key: Column, samples: int, width: int) -> Column:
    """An array of ``samples`` arrays of ``width`` independent standard normal deviates (Box-Muller)."""
    step = 2 * -(-width // 2)
    out = None
    for i in range(0, step, 2):
        polar = F.zip_with(uniforms(key, i, step, samples), uniforms(key, i + 1, step, samples), lambda r, t: F.named_struct(F.lit("r"), F.sqrt(-2 * F.log(r)), F.lit("t"), 2 * F.pi() * t))
        pair = F.transform(polar, lambda p: F.array(*[p["r"] * f(p["t"]) for f in (F.cos, F.sin)][: width - i]))  # noqa: B023
        out = pair if out is None else F.zip_with(out, pair, lambda a, b: F.concat(a, b))
    return out


def drawn(keys: np.ndarray, samples: int, width: int) -> list[np.ndarray]:
    """``normals`` of many keys at once, in a task: ``width`` arrays of a row for each row of ``keys`` (two words), a column for each sample."""
    keys = keys.astype(np.uint32)[:, :, None]
    step, out = 2 * -(-width // 2), []

    def uniform(first: int) -> np.ndarray:
        words = np.arange(first, first + samples * step, step).astype(np.uint32)[None, :]
        for i in (0, 1):
            words = words + keys[:, i]
            for _ in range(2):
                words = (words ^ (words >> np.uint32(16))) * np.uint32(FACTOR)
            words = words ^ (words >> np.uint32(16))
        return (words + 0.5) / WORDS

    for i in range(0, width, 2):
        r, t = np.sqrt(-2 * np.log(uniform(i))), 2 * np.pi * uniform(i + 1)
        out += [r * f(t) for f in (np.cos, np.sin)[: width - i]]
    return out


def duck_mix(word: str) -> str:
    """DuckDB SQL of the mix of a word given as SQL."""
    for _ in range(2):
        word = f"(xor({word}, ({word}) >> 16) * {FACTOR} % {WORDS})"
    return f"xor({word}, {word} >> 16)"


def duck_uniform(counter: str, a: str = "key_a", b: str = "key_b") -> str:
    """DuckDB SQL of the deviate of a counter under the words ``a`` and ``b``."""
    return f"(({duck_mix(f'({duck_mix(f"({counter} + {a}) % {WORDS}")} + {b}) % {WORDS}')} + 0.5) / {WORDS}.0)"


def duck_keys(rows: str, seed: str, part: str) -> str:
    """DuckDB SQL of the table expression ``rows`` with the key's words ``key_a`` and ``key_b``."""
    whole = lambda c: f"coalesce(CAST({c} AS BIGINT), 0)"
    first = ", ".join(f"{duck_mix(f'(({whole(seed)} & {WORDS - 1}) + {salt}) % {WORDS}')} AS key_{n}" for n, salt in (("a", 1), ("b", 2)))
    again = lambda more: "* REPLACE (" + ", ".join(f"{duck_mix(f'(key_{n} + ({more} & {WORDS - 1})) % {WORDS}')} AS key_{n}" for n in "ab") + ")"
    return f"(SELECT {again(whole(part))} FROM (SELECT {again(f'({whole(seed)} >> 32)')} FROM (SELECT *, {first} FROM {rows})))"
